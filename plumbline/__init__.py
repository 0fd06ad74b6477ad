"""Corpus-scale text quality engine on PySpark."""
