"""Adaptive-sampling and sequence-data analytics on Spark DataFrames."""
