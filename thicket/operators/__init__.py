"""Operators on edges(src, dst[, weight]), nodes(id) and labels(id, comm)."""
