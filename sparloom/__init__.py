"""Sparloom: a Spark-first engine for running and analysing language-model programs over large corpora."""

__version__ = "0.1.0"
