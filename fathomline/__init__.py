"""Fathomline: evidence retrieval and text analytics as lazy Spark plans."""

__version__ = "0.1.0"
