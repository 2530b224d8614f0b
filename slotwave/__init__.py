"""Item-popularity analytics on Spark DataFrames."""
