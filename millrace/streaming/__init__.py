"""Structured Streaming into keyed tables."""
