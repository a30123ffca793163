"""Heliodor: retrieval, evaluation and text-corpus analytics as PySpark DataFrames."""
