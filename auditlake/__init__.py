"""Audit tables and documents together with Spark DataFrames."""
