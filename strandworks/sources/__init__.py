"""Strandworks: sources."""
