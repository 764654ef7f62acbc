"""Exact-substring analytics and corpus operations on Spark DataFrames."""

__version__ = "0.1.0"
