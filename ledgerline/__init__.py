"""A PySpark-native engine for temporal transaction graphs."""
