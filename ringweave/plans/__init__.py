"""Whole queries: the search, and the registered queries with their SQL twins."""
