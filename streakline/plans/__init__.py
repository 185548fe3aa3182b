"""Compositions: the customer 360 table, and the analyses bound to a set of tables."""
