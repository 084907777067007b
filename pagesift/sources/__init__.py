"""Readers: query lists, result files, plain text, templates, fetched pages."""
