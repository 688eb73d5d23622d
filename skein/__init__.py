"""Causal-trace analytics as PySpark DataFrame operators keyed by session."""
