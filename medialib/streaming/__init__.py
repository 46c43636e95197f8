"""Structured Streaming jobs over watch events, change feeds and new vectors."""
