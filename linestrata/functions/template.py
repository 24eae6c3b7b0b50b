"""Rewriting of matched lines: templates of literal text and ``$n`` references."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_template(text: str) -> list[str | int]:
    """Literal strings and group numbers in order; a ``$`` without digits refers to group 0."""
    if re.search(r"\$\{|\$\+\{", text):
        raise ValueError("references in braces aren't supported; write $n")
    out: list[str | int] = []
    for literal, reference, digits in re.findall(r"([^$]+)|(\$)(\d*)", text):
        if reference:
            out.append(int(digits or 0))
        else:
            out.append(literal)
    return out


def apply_template(line: Column, pattern: str, pieces: tuple[str | int, ...], groups: int) -> Column:
    """The rewritten line; group 0 is the whole line, groups that took no part are empty."""

    def one(piece: str | int) -> Column:
        if isinstance(piece, str):
            return F.lit(piece)
        if piece == 0:
            return line
        return F.regexp_extract(line, pattern, piece) if piece <= groups else F.lit("")

    return F.concat(*[one(p) for p in pieces])
