"""A PySpark-native engine for property graphs of software symbols."""
