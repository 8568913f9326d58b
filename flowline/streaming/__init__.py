"""Structured Streaming runs of the operators."""
