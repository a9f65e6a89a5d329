"""Operators that prepare training text at scale, with their queries and cross-check SQL."""
