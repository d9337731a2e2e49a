"""Temporal snippets, signals and questions on Spark DataFrames."""
