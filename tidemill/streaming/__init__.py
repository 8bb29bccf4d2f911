"""Operators with state for streams: wait joins, throttles, rolling frames and histories."""
