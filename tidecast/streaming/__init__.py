"""Structured Streaming forms of the layers."""
