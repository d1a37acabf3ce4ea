"""Spark-first web-content analytics: pages in, structured records out."""

__version__ = "0.1.0"
