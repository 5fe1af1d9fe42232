"""Operators: staging, dimensions, facts, incremental loads, checks, features, text."""
