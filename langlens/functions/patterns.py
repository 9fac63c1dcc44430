"""Patterns of byte-wise PCRE as patterns of Java that find something in the same texts, in bounded time.

Read as in multi-line PCRE with CR, LF and CRLF as line ends: `^`, `$` and `.` know no other line ends, `\\b` no other word
characters than ASCII ones; a brace that starts no quantifier, and `[` and `&&` in a class, are plain characters.

Only whether a pattern is found matters, not where. So blanks between a line start and what follows are looked for in
that line alone: if `\\s*` reached over line ends, the last of them starts a line too. Blanks that may come first of all
are left out. Without this, each line start runs through all empty lines after it, and a file of line feeds takes
time that grows with the square or cube of its size.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .. import fixed_values as fixed

_LINE_START = r"(?:\A|(?<=[\r\n])(?!\z|(?<=\r)\n))"
_LINE_END = r"(?=[\r\n]|\z)"
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NO_EDGE = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
_IN_LINE = r"[ \t\x0B\f]*"
_OPEN = re.compile(r"\((?:\?(?:[a-zA-Z-]*[:)]|<?[=!]|>|P?<\w+>))?")
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The character class that begins at i, for Java, and where it ends."""
    out, j = "[", i + 1
    if pattern[j : j + 1] == "^":
        out, j = out + "^", j + 1
    first = j
    while j < len(pattern) and (pattern[j] != "]" or j == first):
        if pattern[j] == "\\":
            out, j = out + pattern[j : j + 2], j + 2
            continue
        plain = pattern[j] in "[]" or pattern.startswith("&&", j)
        out, j = out + ("\\" if plain else "") + pattern[j], j + 1
    return out + "]", j + 1


@lru_cache(4096)
def java_pattern(pattern: str) -> str:
    """The pattern for Java."""
    pattern = fixed.LINEAR.get(pattern, pattern)
    out, i, lead, groups = [], 0, False, []  # lead: only blanks can stand between a line start and here
    while i < len(pattern):
        c = pattern[i]
        if c == "(":
            token = _OPEN.match(pattern, i)[0]
            if not token.endswith(")"):
                groups.append(lead)
            out.append(token)
            i += len(token)
            continue
        if c == "|":
            lead = bool(groups) and groups[-1]
            out.append(c)
            i += 1
            continue
        if c == ")":
            lead = False
            if groups:
                groups.pop()
            out.append(c)
            i += 1
            continue
        if pattern.startswith("\\s*", i) and pattern[i + 3 : i + 4] not in ("+", "?") and (lead or (i == 0 and _one_way(pattern))):
            i += 3
            out.append("" if not lead else _IN_LINE + "+" if _no_blank(pattern, i) else _IN_LINE)
            continue
        if c == "^":
            out.append(_LINE_START)
            lead, i = True, i + 1
            continue
        lead = False
        if c == "\\":
            token = pattern[i : i + 2]
            out.append({"\\b": _EDGE, "\\B": _NO_EDGE}.get(token, token))
            i += 2
        elif c == "[":
            token, i = _class(pattern, i)
            out.append(token)
        elif c == "{":
            token = _QUANTIFIER.match(pattern, i)
            out.append(token[0] if token else "\\{")
            i += len(token[0]) if token else 1
        else:
            out.append({"$": _LINE_END, ".": r"[^\r\n]"}.get(c, c))
            i += 1
    return "".join(out)


def _no_blank(pattern: str, i: int) -> bool:
    """Whether what stands at i can't begin with a blank, so that blanks before it needn't be given back."""
    c = pattern[i : i + 1]
    return c == "\\" and not pattern[i + 1 : i + 2].isalnum() or c.isalnum() or c in tuple("#@%;<-_/\"'=,:!&")


def _one_way(pattern: str) -> bool:
    """Whether no alternative stands outside all groups."""
    depth, i = 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            i = _class(pattern, i)[1] - 1
        elif pattern[i] in "()":
            depth += 1 if pattern[i] == "(" else -1
        elif pattern[i] == "|" and not depth:
            return False
        i += 1
    return True
