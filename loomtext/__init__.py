"""A PySpark-native engine for document analytics."""
