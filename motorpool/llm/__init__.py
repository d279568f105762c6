"""Operators for preparing training text: scans, tokens, near copies, shards, pages, archives and leaks."""
