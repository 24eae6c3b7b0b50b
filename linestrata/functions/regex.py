"""POSIX character classes in patterns for Java's (Spark's) and Python's regex engines.

Fixed values: the twelve POSIX classes and their Java names.  Java and Python take
the first alternative that matches, POSIX the longest; order alternatives
accordingly.
"""

from __future__ import annotations

import re

POSIX_CLASSES = {
    "alnum": "Alnum",
    "alpha": "Alpha",
    "blank": "Blank",
    "cntrl": "Cntrl",
    "digit": "Digit",
    "graph": "Graph",
    "lower": "Lower",
    "print": "Print",
    "punct": "Punct",
    "space": "Space",
    "upper": "Upper",
    "xdigit": "XDigit",
}
#: Members of the classes inside a Python set.
PYTHON_SETS = {
    "Alnum": "0-9A-Za-z",
    "Alpha": "A-Za-z",
    "Blank": r" \t",
    "Cntrl": r"\x00-\x1f\x7f",
    "Digit": "0-9",
    "Graph": r"!-~",
    "Lower": "a-z",
    "Print": r" -~",
    "Punct": r"!-/:-@\[-`{-~",
    "Space": r" \t\n\r\f\v",
    "Upper": "A-Z",
    "XDigit": "0-9A-Fa-f",
}


def to_java(pattern: str) -> str:
    """``[[:digit:]x]`` becomes ``[\\p{Digit}x]``; other patterns stay as they are."""
    return re.sub(r"\[:(\w+):\]", lambda m: rf"\p{{{POSIX_CLASSES[m[1]]}}}" if m[1] in POSIX_CLASSES else m[0], pattern)


def to_python(java: str) -> str:
    def one(m: re.Match) -> str:
        members = PYTHON_SETS.get(m[1])
        if members is None:
            return m[0]
        inside = java[: m.start()].count("[") - java[: m.start()].count("\\[") > java[: m.start()].count("]") - java[: m.start()].count("\\]")
        return members if inside else f"[{members}]"

    return re.sub(r"\\p\{(\w+)\}", one, java)


def group_count(pattern: str) -> int:
    return re.compile(re.sub(r"\\[pP]\{\w+\}", "x", to_python(pattern))).groups
