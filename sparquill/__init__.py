"""sparquill: retrieval, evaluation and corpus preparation over Spark DataFrames."""
