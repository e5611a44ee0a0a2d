"""Structured Streaming over session transcripts."""
