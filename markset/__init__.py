"""Annotation, matching and review analytics as Spark DataFrame operators."""
