"""Static analysis of large file collections on Spark DataFrames."""
