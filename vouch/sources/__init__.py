"""Landed source snapshots to listings. Nothing here fetches: a source is files or a table."""
