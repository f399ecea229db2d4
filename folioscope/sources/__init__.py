"""Readers and writers: printed lines, pages, review tables, rules, manifests, indexes, documents for other tools."""
