"""Scans: key ranges, landed tables, archives, run state and live services."""
