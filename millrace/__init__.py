"""A PySpark-native engine for interned, layered tuple relations."""
