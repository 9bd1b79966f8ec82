"""Spectral time-series analytics on PySpark DataFrames."""
