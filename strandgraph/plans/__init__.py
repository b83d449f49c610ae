"""Queries over relational tables, each with its SQL."""
