"""Document retrieval, evaluation and training-data analytics on Spark DataFrames."""
