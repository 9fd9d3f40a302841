"""Incremental reading of the metrics log."""
