"""millrace: a PySpark-native engine for large-scale data mining."""
