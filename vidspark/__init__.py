"""Spark jobs for the tabular side of a media-authenticity pipeline."""
