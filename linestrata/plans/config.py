"""Options of a mining run, with their validation."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

from linestrata.functions.regex import group_count, to_java, to_python
from linestrata.functions.template import parse_template

log = logging.getLogger("linestrata")

#: The separator used when none is given, and the most tokens kept of a line.
DEFAULT_SEPARATOR = "[ ]+"
MAX_TOKENS = 512


class ConfigError(ValueError):
    """An option, or a combination of options, that isn't allowed."""


@dataclass(frozen=True)
class MinerConfig:
    """All options; patterns are Java regular expressions, POSIX classes are understood.

    ``^`` in a separator isn't given its meaning of "start of the rest of the line".
    """

    inputs: tuple[str, ...] = ()
    support: int = 0
    rsupport: float = 0.0
    separator: str = DEFAULT_SEPARATOR
    byteoffset: int = 0
    lfilter: str | None = None
    template: str | tuple[str, ...] | None = None
    word_sketch_size: int = 0
    cluster_sketch_size: int = 0
    wtablesize: int = 100_000  # accepted, no effect on results
    initseed: int = 1  # seeds the sketches' hash; no effect on results
    wfilter: str | None = None
    wsearch: str | None = None
    wreplace: str | None = None
    replace_mode: str = "iterative"  # or "global": one native pass
    aggrsup: bool = False
    wweight: float = 0.0
    weightf: int = 1
    detailtoken: bool = False
    outliers: str | None = None
    outliers_use_derived: bool = False
    outputmode: int = 0
    debug: int = 0
    syslog: str | None = None
    max_line_bytes: int | None = None
    inline_words: int = 20_000  # frequent words that become part of an expression; more are looked up in a table, or joined, with the same result
    table_bytes: int = 128_000_000  # the largest table of frequent words that every task holds; 0: words are joined
    pieces: tuple = field(init=False, default=())

    def __post_init__(self):
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ConfigError(message)

        put = lambda name, value: object.__setattr__(self, name, value)
        put("support", abs(int(self.support)))
        need(self.support > 0 or self.rsupport > 0, "support or rsupport must be positive")
        need(0 <= self.rsupport <= 100, "rsupport is a percentage")
        need(self.byteoffset >= 0, "byteoffset must not be negative")
        need(self.wtablesize > 0, "wtablesize must be positive")
        need(self.initseed > 0, "initseed must be positive")
        need(self.word_sketch_size >= 0 and self.cluster_sketch_size >= 0, "sketch sizes must not be negative")
        need(0 <= self.wweight <= 1, "wweight must be between 0 and 1")
        need(self.weightf in (1, 2), "weightf is 1 or 2")
        need(self.outputmode in (0, 1), "outputmode is 0 or 1")
        need(self.debug in (0, 1, 2, 3), "debug is 0 to 3")
        need(self.replace_mode in ("iterative", "global"), "replace_mode is iterative or global")
        need(self.max_line_bytes is None or self.max_line_bytes > 0, "max_line_bytes must be positive")
        need(not (self.cluster_sketch_size and self.aggrsup), "a cluster sketch and aggrsup exclude each other")
        for name in ("separator", "lfilter", "wfilter", "wsearch"):
            value = getattr(self, name)
            if value is not None:
                try:
                    put(name, to_java(value))
                    _checked(getattr(self, name))
                except re.error as e:
                    raise ConfigError(f"{name}: {e}") from None
        separator = _checked(self.separator)
        need(separator is None or separator.fullmatch("") is None, "the separator must not match the empty string")
        if self.wfilter is not None:
            need(self.wsearch is not None and self.wreplace is not None, "wfilter needs wsearch and wreplace")
        if self.template is not None:
            text = self.template if isinstance(self.template, str) else "".join(self.template)
            need(bool(text), "an empty template")
            pieces = parse_template(text)
            need(all(isinstance(p, str) or 0 <= p <= 99 for p in pieces), "template references are 0 to 99")
            if self.lfilter is None:
                log.warning("a template without lfilter has no effect")
            else:
                put("pieces", tuple(pieces))

    @property
    def derives(self) -> bool:
        return self.wfilter is not None

    @property
    def groups(self) -> int:
        return group_count(self.lfilter) if self.lfilter else 0


def _checked(java: str) -> re.Pattern | None:
    """The pattern compiled by Python; None if it uses Unicode classes that only Java knows."""
    pattern = to_python(java)
    return None if "\\p{" in pattern else re.compile(pattern)
