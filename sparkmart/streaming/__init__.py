"""Sessions of an event stream, and daily sums kept up to date: beyond what the batch models need."""

from .sessions import daily_counts, gap_sessions

__all__ = ["daily_counts", "gap_sessions"]
