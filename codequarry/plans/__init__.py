"""Whole queries: the bundle and graph plans over a repository, and the table queries."""
