"""Content-addressed delta analytics on Spark DataFrames."""
