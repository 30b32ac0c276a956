"""Deck and content analytics as ordinary Spark jobs."""
