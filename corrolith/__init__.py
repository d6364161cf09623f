"""Evidence-weighted knowledge analytics on Spark DataFrames."""
