"""Columns computed from columns: scalars and traces."""
