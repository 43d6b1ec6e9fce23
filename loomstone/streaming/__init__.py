"""Streams: the batch operators, run on what arrives."""
