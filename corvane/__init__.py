"""Retrieval, content-catalogue and snapshot analytics as Spark DataFrame operators."""
