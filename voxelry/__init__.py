"""A PySpark-native analytics engine for three-dimensional point data."""
