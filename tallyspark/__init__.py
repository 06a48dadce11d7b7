"""A PySpark-native analytics engine for probabilistic quantification data."""
