"""Readers, cohorts, sinks and the run cache."""
