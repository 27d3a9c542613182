"""siftwell: ranked full-text retrieval on Spark DataFrames."""
