"""PySpark-native inspection and structuring of page-oriented documents."""
