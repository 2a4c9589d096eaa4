"""Contracts, pipelines and queries."""
