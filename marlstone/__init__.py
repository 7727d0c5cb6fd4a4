"""marlstone: a PySpark-native engine for retrieval and analytics over organisational knowledge."""
