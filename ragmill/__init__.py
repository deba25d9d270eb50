"""Spark jobs for the data work behind document retrieval systems."""
