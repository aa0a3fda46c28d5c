"""Palimpsest: a PySpark engine that rewrites personal data in tables."""
