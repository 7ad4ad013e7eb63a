"""Readers and writers of graph files, and graphs derived from relational tables."""
