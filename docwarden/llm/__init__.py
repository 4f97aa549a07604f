"""Operators for building training data: one module per operator, queries and their SQL in ``queries``."""
