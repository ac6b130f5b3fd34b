"""A Spark-native engine for datasets and document collections."""
