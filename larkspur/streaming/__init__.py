"""Streaming forms of the stateful operators; the batch forms are authoritative."""
