"""News aggregation, similarity and ranking as Spark DataFrame jobs."""

__version__ = "0.1.0"
