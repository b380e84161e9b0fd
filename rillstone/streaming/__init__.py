"""Unbounded streams by Structured Streaming: sources, count windows, index-free terminals, sinks."""

from .live import count_windows, event_windows, file_lines, foreach_batch, rate, running, socket_lines, to_console

__all__ = ["count_windows", "event_windows", "file_lines", "foreach_batch", "rate", "running", "socket_lines", "to_console"]
