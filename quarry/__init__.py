"""quarry: retrieval, ranking and evaluation as Spark DataFrame plans."""
