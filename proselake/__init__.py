"""A Spark-native engine for text analytics over collections of documents."""
