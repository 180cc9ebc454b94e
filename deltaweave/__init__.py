"""Incremental SQL views on Spark DataFrames."""
