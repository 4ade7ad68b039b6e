"""Compositions of operators, and the registry of queries with their oracle SQL."""
