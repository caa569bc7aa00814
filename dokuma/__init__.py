"""Dokuma: document-graph retrieval and corpus processing as Spark DataFrame programs."""
