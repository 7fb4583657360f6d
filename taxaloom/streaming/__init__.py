"""Streams of stage events."""
