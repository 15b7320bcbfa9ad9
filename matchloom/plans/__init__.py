"""Stages, reports and the catalogue of queries."""
