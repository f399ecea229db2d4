"""Incremental refresh and streams."""
