"""A Spark-native engine for hierarchical, ordered, authenticated key-value data."""
