"""A PySpark-native engine for code-graph analytics."""
