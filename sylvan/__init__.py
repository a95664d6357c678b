"""Sylvan: hierarchical clustering and graph analytics on Spark DataFrames."""
