"""Personal-health time-series analytics on Spark DataFrames."""
