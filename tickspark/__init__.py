"""Tick-data analytics on Spark DataFrames."""
