"""Analyses as functions from DataFrames and a campaign spec to one lazy DataFrame."""
