"""A PySpark-native engine for semantic filters and training-data preparation."""
