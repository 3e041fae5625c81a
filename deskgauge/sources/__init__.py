"""Readers, extracts, snapshots and sinks."""
