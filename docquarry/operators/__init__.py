"""Operators over pages, chunks, vectors, hits and answers."""
