"""engram: hybrid retrieval, long-term memory and corpus processing as Spark plans."""

__version__ = "0.1.0"
