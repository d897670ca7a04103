"""Spark-first operators for chart, touch, session, document and request tables."""
