"""Lodestone: document, graph and retrieval analytics as Spark DataFrame programs."""
