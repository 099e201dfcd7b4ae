"""A Spark-native engine for streams of articles, pages and interaction events."""
