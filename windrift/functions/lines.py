"""What `text` says of settings, for one string at a time: the same rules in plain Python, for long work within a task.

Patterns mean what they mean in Java: `.` is any character but an end of line, `$` is the end, or before an end of line there.
"""

from __future__ import annotations

import re

from windrift.functions.text import FALSE_WORDS, TRUE_WORDS

#: What ends a line in a Java pattern.
ENDS = "\n\r\x85\u2028\u2029"


def pattern(java: str) -> re.Pattern[str]:
    return re.compile(java.replace(".*", f"[^{ENDS}]*").replace("$", rf"(?=[{ENDS}]?\Z)"), re.ASCII)


ENTRY = pattern(r"^\s*[^=\s/#][^=]*=")
BARE_ENTRY = pattern(r"^\s*[^=\s][^=]*=")
COMMENT = pattern(r"""^((?:[^"'/#]|"[^"]*"|'[^']*'|/(?!/))*)(?://|#).*$""")
VALUE = pattern(r"=(.*)$")
QUOTED = pattern(r"""^(["'])(.*)\1$""")
BLANKS = pattern(r"[\s_-]+")
BRACKETS = pattern(r"^\[|\]$")
UNIT = pattern(r"\s*(%|m/s)$")
POINT = pattern(r"(?<=\d)p(?=\d)")
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", re.ASCII)
CONTROLS = "".join(map(chr, range(33)))


def stripped_comment(line: str) -> str:
    if "#" in line or "//" in line:
        line = COMMENT.sub(r"\1", line)
    return line.rstrip(" ")


def unquoted(x: str) -> str:
    x = x.strip(" ")
    return QUOTED.sub(r"\2", x) if x[:1] in ('"', "'") else x


def key_name(x: str) -> str:
    return BLANKS.sub("_", x.strip(" ").lower())


def entry(line: str) -> tuple[str, str] | None:
    """(key, raw) of a line that says something."""
    if "=" not in line or not ENTRY.match(line):
        return None
    said = stripped_comment(line)
    if not BARE_ENTRY.match(said):
        return None
    raw = VALUE.search(said)
    return key_name(said.partition("=")[0]), unquoted(raw[1] if raw else "")


def number(x: str) -> float | None:
    t = x.strip(" ").lower()
    if "%" in t or "m/s" in t:
        t = UNIT.sub("", t)
    if "p" in t:
        t = POINT.sub(".", t)
    t = t.replace(",", ".")
    # An end of line after it belongs to the number, other blanks don't.
    bare = t.rstrip(CONTROLS) if t[-1:] in ("\n", "\r") and t[-2:-1].strip(CONTROLS) else t
    n = float(bare) if NUMBER.fullmatch(bare) else None
    return n if n is not None and abs(n) < float("inf") else None


def truth(x: str) -> bool | None:
    t = x.strip(" ").lower()
    if t in TRUE_WORDS:
        return True
    if t in FALSE_WORDS:
        return False
    n = number(t)
    return None if n is None else n != 0


def pair(x: str) -> list[float] | None:
    items = [v for v in map(unquoted, BRACKETS.sub("", x.strip(" ")).split(",")) if v != ""]
    values = [number(v) for v in items]
    return sorted(values) if len(values) == 2 and None not in values else None
