"""Incremental (Structured Streaming) use of the stateless operators."""

from wattle.streaming.incremental import (  # noqa: F401
    audit_stream,
    clean_stream,
    day_counts_stream,
    read_stream,
    start,
)
