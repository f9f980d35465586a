"""Composite pipelines and the registered queries."""
