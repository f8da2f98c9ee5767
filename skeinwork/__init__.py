"""skeinwork: Spark-native analytics over code graphs, texts, sessions and events."""

__version__ = "0.1.0"
