from dbgauge.streaming.growing import read_growing_lines
from dbgauge.streaming.increments import late_rows, read_increments, untimed_rows, write_increments
from dbgauge.streaming.jobs import (
    digest_stream,
    ingest_logs,
    ingest_pg_logs,
    ingest_pg_series,
    read_entry_stream,
    read_line_stream,
    read_windows,
    stream_alerts,
    stream_digests,
    untimed_entries,
    write_windows,
)

__all__ = [
    "digest_stream",
    "ingest_logs",
    "ingest_pg_logs",
    "ingest_pg_series",
    "late_rows",
    "read_entry_stream",
    "read_growing_lines",
    "read_increments",
    "read_line_stream",
    "read_windows",
    "stream_alerts",
    "stream_digests",
    "untimed_entries",
    "untimed_rows",
    "write_increments",
    "write_windows",
]
