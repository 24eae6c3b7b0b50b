"""Derived words: replace what matches in words of a certain kind."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Replacements, and the length of the result, after which a word that never settles is left as it is by then.
MAX_REPLACEMENTS = 10_000
MAX_LENGTH = 1_000_000


def eligible(word: Column, wfilter: str, wsearch: str) -> Column:
    """Words that have a derived form: both patterns are found in them."""
    return word.rlike(wfilter) & word.rlike(wsearch)


def replace_repeatedly(word: str, search: re.Pattern, replacement: str) -> str:
    """Replace the leftmost match, again and again.

    From the second round on it stops when the match is a prefix of the
    replacement, so ``=VALUE`` isn't replaced for ever.
    """
    for round_ in range(MAX_REPLACEMENTS):
        m = search.search(word)
        if m is None or (round_ and replacement.startswith(m[0])):
            break
        word = word[: m.start()] + replacement + word[m.end() :]
        if len(word) > MAX_LENGTH:
            break
    return word


def derive_global(word: Column, wsearch: str, replacement: str) -> Column:
    """One pass over all matches, in the JVM."""
    return F.regexp_replace(word, F.lit(wsearch), F.lit(replacement.replace("\\", "\\\\").replace("$", "\\$")))


def grouped_number(n: Column) -> Column:
    """1234567 -> 1,234,567"""
    return F.format_number(n, 0)
