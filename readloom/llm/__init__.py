"""Operators for preparing training data: deduplication, search, scoring, mixing, packing and token files.

Each module holds one operator with its own general interface; ``registry`` binds them to the driver's tables.
"""
