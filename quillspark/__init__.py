"""A Spark-native engine for building and analysing a corpus of scholarly papers."""
