"""Structured Streaming forms of the calendar-bucket counts (R1) and the
session builder (R14).  The reference has no streaming; this is an extra
for users who feed events continuously."""

from quarry.streaming.events import event_stream, session_counts, windowed_counts, write_stream

__all__ = ["event_stream", "windowed_counts", "session_counts", "write_stream"]
