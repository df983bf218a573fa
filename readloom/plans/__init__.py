"""Building blocks that several operators share, and sizing rules."""
