"""unitloom: Spark-native multi-vector retrieval, evaluation and corpus operators."""
