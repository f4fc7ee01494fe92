"""Incremental listings analytics on PySpark: columns, operators, plans."""

__all__ = ["session"]
__version__ = "0.1.0"
