"""Strandworks: functions."""
