"""Fixtures and registered queries with their SQL counterparts."""
