"""Distance-aware community detection on Spark DataFrames."""
