"""Readers, file listings and sinks."""
