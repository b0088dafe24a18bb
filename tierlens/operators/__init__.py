"""Encodings, squeezed columns, selections and the cache registry."""
