"""Temporal interaction graphs and corpus preparation on Spark DataFrames."""
