"""Operators over long series ``(series, date, value)`` and labelled points; each is a function from frames to a frame."""
