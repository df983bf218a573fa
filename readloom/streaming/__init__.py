"""Stateless operators over arriving overlap batches."""
