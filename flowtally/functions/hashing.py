"""Content and change hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(columns: Sequence[str], prefix: int | None = None) -> Column:
    """SHA-256 of the key-sorted JSON object of ``columns``, NULLs kept as ``null``."""
    if not columns:
        raise ValueError("content_hash needs at least one column")
    packed = F.struct(*[F.col(c) for c in sorted(columns)])
    digest = F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)
    return F.substring(digest, 1, prefix) if prefix else digest


def change_hash(columns: Sequence[str], compat: bool = False) -> Column:
    """Hash that tells whether tracked columns changed.

    The default keeps NULL apart from every string.  ``compat`` is the
    MD5 of the values joined by a bar; one NULL makes the whole hash NULL.
    """
    if not columns:
        raise ValueError("name at least one column to compare")
    if not compat:
        packed = F.struct(*[F.col(c) for c in columns])
        return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit("|"), F.col(c).cast("string")] if parts else [F.col(c).cast("string")]
    return F.md5(F.concat(*parts))
