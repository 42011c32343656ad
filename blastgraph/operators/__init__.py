"""Operators over graph tables: resolution, edges, traversal, matching, cover."""
