"""Sequence-prefix analytics on Spark DataFrames."""
