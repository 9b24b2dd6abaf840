"""Echolith: a Spark-native engine for activity histories (ingest, search, retention, statistics)."""

__version__ = "0.1.0"
