"""Strandworks: streaming."""
