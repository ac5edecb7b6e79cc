"""Incremental forms of the scans."""
