"""Spark-first analytics over documents and structured facts."""
