"""Reading and cleaning of the four campaign exports."""
