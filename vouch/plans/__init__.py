"""Composite jobs: index, search, quality, moderation, cities."""
