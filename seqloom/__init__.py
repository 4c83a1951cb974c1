"""Sequence-pattern analytics on Spark DataFrames."""
