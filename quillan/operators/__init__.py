"""Relational operators: search, filters, diversification, statistics."""
