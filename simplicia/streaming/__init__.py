"""Structured Streaming over judgement logs."""
