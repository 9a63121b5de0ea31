"""Scores of linguistic annotations, computed with Spark."""
