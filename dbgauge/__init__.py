"""Database diagnostics over a fleet of instances, as PySpark DataFrame jobs."""

__version__ = "0.1.0"
