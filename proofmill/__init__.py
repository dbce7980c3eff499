"""Strongly constrained fact databases and analytics on Spark DataFrames."""
