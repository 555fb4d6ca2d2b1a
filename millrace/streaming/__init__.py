"""Structured Streaming forms of bounded operators."""
