"""Operators over overlap, read, interval and mask relations: each takes frames and returns a frame."""
