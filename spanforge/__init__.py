"""spanforge: span detection, reconciliation, replacement and rewriting of document tables with PySpark."""

__version__ = "0.1.0"
