"""Tidemark: a PySpark engine that investigates movements in business metrics."""

__version__ = "0.1.0"
