from dbgauge.sources.files import latest_files, list_files, resolve_log_paths
from dbgauge.sources.logs import lines_from_table, read_log_lines, read_slow_log_records
from dbgauge.sources.records import read_records, read_summaries, typed_records, write_records

__all__ = [
    "latest_files",
    "lines_from_table",
    "list_files",
    "read_log_lines",
    "read_records",
    "read_slow_log_records",
    "read_summaries",
    "resolve_log_paths",
    "typed_records",
    "write_records",
]
