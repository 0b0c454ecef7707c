"""A PySpark-native engine for ordered market data."""
