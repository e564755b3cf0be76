"""Block-metadata analytics on Spark DataFrames."""
