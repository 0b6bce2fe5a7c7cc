"""Structured Streaming entry point: micro-batch scoring of query cases."""

from casediff.streaming.scoring import score_stream

__all__ = ["score_stream"]
