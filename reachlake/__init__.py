"""Reachability analytics over code-fact graphs, on Spark DataFrames."""
