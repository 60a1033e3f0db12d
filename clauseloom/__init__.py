"""Contract-text analytics on Spark DataFrames."""
