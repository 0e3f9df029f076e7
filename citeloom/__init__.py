"""Evidence retrieval, judgement and training-data operators on Spark DataFrames."""
