"""treeloom: content-addressed analysis of large file trees on PySpark."""

__version__ = "0.1.0"
