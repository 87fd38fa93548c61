"""Relational operators over landed papers, citations, archives and run ledgers."""
