"""Geospatial and transit analytics on Spark DataFrames."""
