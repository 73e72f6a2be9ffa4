"""Operators on cohorts and on the long predictions table."""
