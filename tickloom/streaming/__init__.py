"""Streams of ticks to bars and live rules."""
