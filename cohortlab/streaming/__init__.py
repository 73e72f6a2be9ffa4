"""Scoring of a stream of subjects."""
