"""The daily job as a stream of files."""

from editwarden.streaming.daily import (  # noqa: F401
    read_stream, score_stream, snapshot_counts, stored_batches, stream_summary, summary_of_batches,
)
