"""Keepwell: retention analytics as Spark jobs."""
