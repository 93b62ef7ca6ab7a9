"""tidemark: retrieval analytics on Spark DataFrames."""
