"""marlstone: a PySpark-native engine for trees of nested key/value scripts and large tables."""
