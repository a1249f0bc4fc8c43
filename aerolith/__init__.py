"""Quality-flagged time-series analytics on Spark DataFrames."""
