"""Lodestar: a columnar analytical SQL engine on PySpark."""
