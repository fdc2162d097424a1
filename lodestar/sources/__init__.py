"""Stored tables: commits, files, constraints and partitions."""
