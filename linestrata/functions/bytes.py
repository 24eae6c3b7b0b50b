"""Lines cut by bytes instead of characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part_of_bytes(line: Column, start: Column | int, length: int) -> Column:
    """``length`` bytes of a line from byte ``start`` (from 1) on.

    What is left of a character that is cut through becomes U+FFFD: one for each
    of its bytes behind the cut, one for all those before it.
    """
    part = F.substring(line.cast("binary"), F.lit(start) if isinstance(start, int) else start, F.lit(length))
    return F.make_valid_utf8(part.cast("string"))
