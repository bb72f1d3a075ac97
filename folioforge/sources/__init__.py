"""Readers: bytes or texts to rows of nodes."""
