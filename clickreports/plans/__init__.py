"""Shared pre-aggregates and the reports planned over them."""
