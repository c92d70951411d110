"""Regular expressions with the meaning that Unicode-aware engines give them."""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


START = rf"(?<!{WORD})"
END = rf"(?!{WORD})"


def alternatives(pattern: str, at: int) -> list[str]:
    """The alternatives of the group that opens at a place of the pattern (without its ?: if it has one)."""
    depth, part, out = 0, "", []
    i = at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            part += pattern[i : i + 2]
            i += 2
            continue
        if c == "[":
            end = pattern.index("]", i + 2)
            part += pattern[i : end + 1]
            i = end + 1
            continue
        depth += (c == "(") - (c == ")")
        if not depth:
            break
        if c == "|" and depth == 1:
            out.append(part)
            part = ""
        elif i > at:
            part += c
        i += 1
    return [x.removeprefix("?:") for x in (*out, part)]


def boundary(m: re.Match) -> str:
    """A boundary's test; one look is enough where a letter is known to stand on one side."""
    pattern, at = m.string, m.end()
    if pattern[at : at + 1].isalpha():
        return START
    if pattern[at : at + 1] == "(" and pattern[at + 1 : at + 3] not in ("?!", "?=", "?<") and all(x[:1].isalpha() for x in alternatives(pattern, at)):
        return START
    if m.start() and pattern[m.start() - 1].isalpha() and pattern[m.start() - 2 : m.start() - 1] != "\\":
        return END
    return BOUNDARY


def py_regex(pattern: str, *, ignore_case: bool = False) -> str:
    r"""A Java pattern whose \d, \s, \w and \b are Unicode's, as in Python: all numbers are word characters."""
    return ("(?iU)" if ignore_case else "(?U)") + re.sub(r"\\b", boundary, pattern)
