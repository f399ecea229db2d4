"""Folioscope: document lineage, search and linking on PySpark."""
