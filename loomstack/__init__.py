"""Code and text analytics on Spark DataFrames."""
