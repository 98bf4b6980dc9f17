"""Strandworks: operators."""
