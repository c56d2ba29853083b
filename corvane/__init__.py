"""corvane: a Spark-native engine for crawl state, inverted index, ranking and link analysis."""

__version__ = "0.1.0"
