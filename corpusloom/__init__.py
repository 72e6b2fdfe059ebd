"""corpusloom: Spark-native hybrid retrieval and document processing."""

__version__ = "0.1.0"
