"""millweir: a PySpark-native data preparation, quality and medallion engine."""
