"""Ordered-series and regime analytics on Spark DataFrames."""
