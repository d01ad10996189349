"""Spark-first analytics over versioned rule texts, documents and event tables."""
