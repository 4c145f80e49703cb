"""Readers, sinks and path resolution."""
