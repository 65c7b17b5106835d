"""Structured Streaming jobs; each also runs once over what is there."""

from . import jobs  # noqa: F401
