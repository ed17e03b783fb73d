"""PySpark-native walk-forward portfolio research engine."""
