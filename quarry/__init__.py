"""quarry: a Spark-first engine for retrieval, grounded answers and their evaluation."""
