"""Continuous ingest: each micro-batch of a stream becomes one commit."""
