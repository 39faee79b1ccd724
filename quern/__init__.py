"""quern: a PySpark-native code-retrieval and corpus-preparation engine."""

__version__ = "0.1.0"
