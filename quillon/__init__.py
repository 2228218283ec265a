"""A PySpark-native engine for compiled knowledge bases."""
