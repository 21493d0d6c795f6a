"""A PySpark-native engine that prepares relational data for learning."""
