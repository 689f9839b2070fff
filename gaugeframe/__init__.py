"""A PySpark-native engine for evaluation scores, transfer analysis and training-data preparation."""
