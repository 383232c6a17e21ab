"""A PySpark-native analytics engine for code-change data."""
