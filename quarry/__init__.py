"""Quarry: a PySpark-native engine to build, query and evaluate text-retrieval corpora."""
