"""Mutation logs and their live tables."""
