"""Queries: the registry that the repository's entry module exposes."""
