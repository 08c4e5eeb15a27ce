"""A market time-series analytics engine on Spark DataFrames."""
