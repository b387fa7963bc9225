"""Incremental forms of operators over streams of pixels."""
