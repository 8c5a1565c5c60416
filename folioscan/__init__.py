"""Spark jobs that check large collections of documents against templates."""
