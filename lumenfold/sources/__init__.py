"""Readers for the catalogue tables."""
