"""A PySpark-native engine for text-line recognition dataflows and training-corpus preparation."""
