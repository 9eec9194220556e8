"""quarry: retrieval, ranking and incremental ingestion over Spark DataFrames."""
