"""Sequence, pangenome and text analytics as Spark DataFrame operations."""
