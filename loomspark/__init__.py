"""A Spark-native engine for feature analytics."""
