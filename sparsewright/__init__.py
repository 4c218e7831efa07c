"""Sparse matrix completion and the analytics around it, on Spark DataFrames."""
