"""Readers and writers (S1, S3-S10, S13) and HTML extraction."""
