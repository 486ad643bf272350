"""Clock columns. The engine clock is epoch milliseconds in a BIGINT column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per unit of a duration text.
_UNIT_MS = {
    "millisecond": 1,
    "second": 1_000,
    "minute": 60_000,
    "hour": 3_600_000,
    "day": 86_400_000,
    "week": 604_800_000,
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_ms(text: str | int) -> int:
    """``"5 minutes"`` as 300000. An int is taken as milliseconds already."""
    if isinstance(text, int):
        return text
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower())
    if not match or match[2] not in _UNIT_MS:
        raise ValueError(f"not a duration: {text!r}")
    return int(match[1]) * _UNIT_MS[match[2]]


def millis(ts) -> Column:
    """Epoch milliseconds of a TIMESTAMP or (read as UTC) TIMESTAMP_NTZ column."""
    return F.unix_millis(col(ts).cast("timestamp"))


def window_start(ms, size: str | int) -> Column:
    """Start of the epoch-aligned tumbling window that holds ``ms``: now - now mod d."""
    return col(ms) - F.pmod(col(ms), F.lit(duration_ms(size)))
