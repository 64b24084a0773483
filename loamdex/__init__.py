"""loamdex: a document retrieval and text processing engine written for PySpark."""

__version__ = "0.1.0"
