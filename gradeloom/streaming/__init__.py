"""Structured Streaming jobs over the action log and the predictions folder."""
