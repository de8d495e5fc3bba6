"""Enumeration, counting, selection, sketching and length partitioning."""
