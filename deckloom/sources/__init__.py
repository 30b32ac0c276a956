"""Readers and writers, and the views that turn the given tables into decks, slides and shapes."""
