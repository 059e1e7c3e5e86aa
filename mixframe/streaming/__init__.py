"""Structured Streaming versions of scoring, metrics and initialisation."""
