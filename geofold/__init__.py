"""Geospatial world analytics on PySpark DataFrames."""
