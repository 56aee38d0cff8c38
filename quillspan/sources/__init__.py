"""Readers of session transcripts and tables."""
