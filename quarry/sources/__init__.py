"""Scans, loaders and sinks (IO ops)."""
