"""Streaming SQL on Spark: a small dialect, compiled to DataFrames."""
