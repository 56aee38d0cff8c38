"""Operators on event sequences, groups of occurrences, placements, evaluations and ledgers."""
