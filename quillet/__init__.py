"""A PySpark-native engine for text-pair metrics and record processing."""
