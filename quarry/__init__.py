"""quarry: a PySpark-native document-analytics engine."""
