"""Readers and report writers."""
