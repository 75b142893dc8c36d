"""Evidence retrieval, fusion and corpus preparation as batched Spark plans."""

__version__ = "0.1.0"
