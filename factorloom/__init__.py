"""PySpark-native recommendation analytics over explicit ratings."""
