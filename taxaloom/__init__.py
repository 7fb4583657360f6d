"""Spark jobs for curated group-comparison records."""
