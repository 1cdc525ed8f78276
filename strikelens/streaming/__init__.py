"""Structured Streaming versions of the tape operators."""
