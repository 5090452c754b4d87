"""Analytics on facts, documents and embeddings, on Spark DataFrames."""
