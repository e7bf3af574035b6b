"""A Spark-native engine for building and measuring document retrieval."""
