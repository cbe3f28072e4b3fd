"""Keyed streams and tables as Spark plans."""
