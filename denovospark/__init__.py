"""Mass-spectrum analytics on Spark DataFrames."""
