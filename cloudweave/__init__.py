"""Point-set analytics on Spark DataFrames."""
