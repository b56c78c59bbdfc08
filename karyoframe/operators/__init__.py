"""Interval, join and variant operators over alignment frames."""
