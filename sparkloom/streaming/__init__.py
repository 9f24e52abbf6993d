"""Structured Streaming over event tables (an addition: batch queries need none of it)."""

from .events import read_stream, run_to_end, session_totals, sliding_counts, tumbling_totals

__all__ = ["read_stream", "run_to_end", "session_totals", "sliding_counts", "tumbling_totals"]
