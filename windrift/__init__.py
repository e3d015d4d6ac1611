"""Spark-first analytics over gridded wind fields, urban geometry and their tables."""
