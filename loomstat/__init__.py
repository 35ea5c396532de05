"""Pairwise connectivity statistics on Spark DataFrames."""
