"""Registered queries, by operator id."""
