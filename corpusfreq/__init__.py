"""Corpus statistics on PySpark."""
