"""Extraction evaluation and annotation audit as Spark DataFrame operators."""
