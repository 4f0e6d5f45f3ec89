"""Readers, sinks and provenance checks."""
