"""Pipelines as configuration, and the catalogue of queries."""
