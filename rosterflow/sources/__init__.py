"""Readers, parsers and writers for change logs, event streams and knowledge tables."""
