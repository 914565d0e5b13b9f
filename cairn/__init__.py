"""Cairn: retrieval, knowledge-graph and document analytics as Spark jobs."""
