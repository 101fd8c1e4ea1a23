"""tarnlake: a Spark-native engine for conversational-assistant logs, corpora and retrieval."""

__version__ = "0.1.0"
