"""Strandworks: plans."""
