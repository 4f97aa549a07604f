"""Structured Streaming jobs; each has a batch form that must give the same rows."""
