"""Relational operators on reads, bases, sites and sparse matrices."""
