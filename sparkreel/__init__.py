"""Clip analytics on Spark DataFrames."""
