"""Delimited-format parsing and reduction on Spark DataFrames."""

__version__ = "0.1.0"
