"""Posed-sensor analytics on Spark: scan, align, decode and corpus queries as DataFrames."""
