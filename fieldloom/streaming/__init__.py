"""Structured Streaming form of the tape reduction."""
