"""Write modes."""

from flowtally.sinks.writes import (
    append_log,
    current_version,
    insert_if_absent,
    merge_upsert,
    publish_version,
    read_current,
    save_table,
    write_append,
    write_overwrite,
)

__all__ = [
    "append_log",
    "current_version",
    "insert_if_absent",
    "merge_upsert",
    "publish_version",
    "read_current",
    "save_table",
    "write_append",
    "write_overwrite",
]
