"""Artifact discovery, record scans and the tables of a case."""
