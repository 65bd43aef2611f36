"""Batch record recognition and entity matching on Spark DataFrames."""
