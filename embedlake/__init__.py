"""A PySpark-native engine that keeps text and its embeddings queryable."""
