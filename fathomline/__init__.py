"""Retrieval analytics as Spark plans."""
