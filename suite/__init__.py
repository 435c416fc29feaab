"""Registered queries and their SQL counterparts, grouped by subject."""
