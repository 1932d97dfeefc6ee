"""Queries in pieces: chunk by chunk, or as a stream arrives."""

from rangeloom.streaming.iterate import OverlapIterator
from rangeloom.streaming.stream import stream_overlaps

__all__ = ["OverlapIterator", "stream_overlaps"]
