"""Scans, sinks, file-system helpers and checkpoints."""
