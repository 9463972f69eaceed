"""Constraint-audit analytics on Spark DataFrames."""
