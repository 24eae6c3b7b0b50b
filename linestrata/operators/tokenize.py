"""Lines to tokens: offset, filter, template, separator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestrata.functions.binding import let
from linestrata.functions.bytes import part_of_bytes
from linestrata.functions.template import apply_template
from linestrata.plans.config import MAX_TOKENS, MinerConfig


def drop_bytes(line: Column, n: int) -> Column:
    """The line without its first n bytes."""
    return part_of_bytes(line, n + 1, 2_000_000_000) if n else line


def split_line(line: Column, separator: str, cap: int = MAX_TOKENS) -> Column:
    """Tokens between separators.

    A separator at the start gives an empty first token, one at the end gives
    none, neighbouring ones give empty tokens between them.
    """

    def kept(parts: Column) -> Column:
        n = F.size(parts) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, 1, F.least(n, F.lit(cap)))

    return let(F.split(line, separator), kept)


def prepared(line: Column, config: MinerConfig) -> Column:
    """The text that is split: null for lines that yield no words."""
    text = line
    usable = line != ""
    if config.byteoffset:
        text = drop_bytes(line, config.byteoffset)
        usable = F.octet_length(line) > config.byteoffset
    if config.lfilter is not None:
        usable = usable & text.rlike(config.lfilter)
        if config.pieces:
            text = apply_template(text, config.lfilter, config.pieces, config.groups)
    return F.when(usable, text)


def tokens_of(line: Column, config: MinerConfig) -> Column:
    none = F.array().cast("array<string>")
    return let(prepared(line, config), lambda text: F.when(text.isNull(), none).otherwise(split_line(text, config.separator)))


def tokenize(lines: DataFrame, config: MinerConfig) -> DataFrame:
    """line_id, value, tokens; every line stays, lines without words have an empty array."""
    return lines.select("line_id", "value", tokens_of(F.coalesce("value", F.lit("")), config).alias("tokens"))
