"""Readers for tables and for JSON record files."""

from flowtally.sources.files import file_manifest
from flowtally.sources.records import read_json_dir, read_jsonl, read_overrides, read_wrapped_json
from flowtally.sources.tables import read_table

__all__ = [
    "file_manifest",
    "read_json_dir",
    "read_jsonl",
    "read_overrides",
    "read_table",
    "read_wrapped_json",
]
