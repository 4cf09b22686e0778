"""PySpark-native operators for tables of scientific literature."""
