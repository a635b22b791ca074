"""Streaming forms: resumable appends of dialogue records."""
