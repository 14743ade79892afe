"""Incremental work: an index that follows a repository, and anchors from a running log."""
