"""Tabular machine learning and data profiling as Spark jobs."""
