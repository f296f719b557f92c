"""glossa: a Spark-first engine for annotated document corpora."""

__version__ = "0.1.0"
