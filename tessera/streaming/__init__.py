"""Structured Streaming operators (T01-T10) and their batch twins."""
