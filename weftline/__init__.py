"""weftline: a PySpark-native batch engine for code-knowledge analytics."""
