"""Flowline: keyed message pipelines and change-data capture on Spark DataFrames and Structured Streaming."""
