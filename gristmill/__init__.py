"""Columnar text analytics on Spark: pattern matching operators over DataFrames."""
