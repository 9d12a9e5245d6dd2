"""Spark jobs for research on market bars."""
