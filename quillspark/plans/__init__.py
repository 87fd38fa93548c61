"""Whole runs composed of operators, and their exports."""
