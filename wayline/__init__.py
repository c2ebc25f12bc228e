"""wayline: a PySpark-native engine for linear-referenced data, survey tabulation and corpus preparation."""
