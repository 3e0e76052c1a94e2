"""Tidemark: point-in-time-correct temporal features and probabilistic evaluation as Spark plans."""
