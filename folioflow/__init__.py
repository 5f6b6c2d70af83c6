"""folioflow: a PySpark-native engine for document analytics."""
