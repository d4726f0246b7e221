"""A PySpark-native engine for ordering and generating numbered text lines."""
