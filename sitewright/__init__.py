"""Site-level RNA editing analytics on Spark DataFrames."""
