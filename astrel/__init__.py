"""A Spark-native engine that analyses corpora of source files and texts as tables."""
