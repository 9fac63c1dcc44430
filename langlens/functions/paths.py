"""Names, extensions and path globs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def filename(path: Column) -> Column:
    """The last component; null if there is none (a path that ends in '/', '.' or '..')."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(~name.isin("", ".", ".."), name)


def extension(name: Column, known: list[str]) -> Column:
    """The longest known extension of a file name, in ASCII lower case; null if none is known.

    One leading dot is no part of it: '.cs' has none, 'x.cmake.in' has '.cmake.in' if that is known."""
    lowered = F.translate(F.regexp_replace(name, r"^\.", ""), _UPPER, _LOWER)
    parts, depth = F.split(lowered, r"\."), max((e.count(".") for e in known), default=1)
    first = F.greatest(F.lit(2), F.size(parts) - (depth - 1))  # no known extension has more dots
    suffixes = F.when(F.size(parts) > 1, F.transform(F.sequence(first, F.size(parts)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    # As text, which is parsed once: a column for each of a thousand extensions would take the driver half a second.
    among = F.expr(f"s -> s IN ({', '.join(map(literal, known)) or 'null'})")
    return F.get(F.call_function("filter", suffixes, among), 0)


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression for whole relative paths: **, *, ?, [classes] and {alternatives}."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("\\", "\\\\") + "]", end + 1
        elif c in "{},":
            depth = glob.count("{", 0, i) - glob.count("}", 0, i)
            out, i = out + ("(?:" if c == "{" else ")" if c == "}" else "|" if depth else ","), i + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^(?:{out})$"


_WILD = re.compile(r"[*?\[{]")


def _literals(glob: str) -> list[str]:
    """What a piece of a glob without * and ? stands for: [classes] and {alternatives} written out; [] if there are too many."""
    out = [""]
    i = 0
    while i < len(glob):
        if glob[i] in "*?]}" or len(out) > 64:
            return []
        if glob[i] in "[{":
            end = glob.find("]" if glob[i] == "[" else "}", i + 1)
            if end < 0:
                return []
            inside = glob[i + 1 : end]
            if glob[i] == "[" and (inside[:1] in "!^" or "-" in inside[1:-1]) or glob[i] == "{" and _WILD.search(inside):
                return []
            choices, i = (list(inside) if glob[i] == "[" else inside.split(",")), end + 1
        else:
            choices, i = [glob[i]], i + 1
        out = [x + c for x in out for c in choices]
    return out


class GlobIndex:
    """Globs by what decides them: names of folders (**/name/**), names of files and folders (**/name), and the rest as one
    regular expression, which is tried only where a path has a segment, or a segment's ending or beginning, that the rest needs."""

    def __init__(self, globs: list[str]) -> None:
        self.folders: set[str] = set()
        self.names: set[str] = set()
        self.segments: set[str] = set()
        self.endings: set[str] = set()
        self.beginnings: set[str] = set()
        self.rest: list[str] = []
        self.always = False
        for glob in dict.fromkeys(globs):
            inner = glob.removeprefix("**/").removesuffix("/**")
            known = _literals(inner) if glob.startswith("**/") and "/" not in inner else []
            if known:
                (self.folders if glob.endswith("/**") else self.names).update(known)
                continue
            self.rest.append(glob)
            parts = [x for x in glob.split("/") if x != "**"]
            whole = min((x for x in map(_literals, parts) if x), key=len, default=[])
            ending, beginning = (_literals(parts[-1][a:b]) for a, b in ((parts[-1].rfind("*") + 1, None), (0, max(0, parts[-1].find("*")))))
            if whole:
                self.segments.update(whole)
            elif ending and all(ending):
                self.endings.update(ending)
            elif beginning and all(beginning):
                self.beginnings.update(beginning)
            else:
                self.always = True

    def _needed(self, parts: Column) -> Column:
        if self.always:
            return F.lit(True)
        tests = [(F.endswith, x) for x in sorted(self.endings)] + [(F.startswith, x) for x in sorted(self.beginnings)]
        some = F.exists(parts, lambda x: reduce(lambda a, b: a | b, (test(x, F.lit(e)) for test, e in tests))) if tests else F.lit(False)
        return some | _overlap(parts, self.segments)

    def matches(self, path: Column) -> Column:
        parts = F.split(path, "/")
        last = F.element_at(parts, -1)
        inside = _overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), self.folders) & (last != "")
        plain = inside | last.isin(*sorted(self.names)) if self.names else inside
        return plain | (self._needed(parts) & path.rlike("|".join(map(glob_regex, self.rest)))) if self.rest else plain

    def excluded(self, path: Column) -> Column:
        parts = F.split(path, "/")
        inside = _overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), self.folders) & (F.element_at(parts, -1) != "")
        plain = inside | _overlap(parts, self.names)
        if not self.rest:
            return plain
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        return plain | (self._needed(parts) & F.exists(above, lambda p: p.rlike("|".join(map(glob_regex, self.rest)))))


def _overlap(parts: Column, names: set[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, sorted(names)))) if names else F.lit(False)


def matches(path: Column, globs: list[str]) -> Column:
    """Whether a relative path itself matches any of the globs."""
    return GlobIndex(globs).matches(path)


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a relative path or a directory above it matches: a walk does not enter such a directory."""
    return GlobIndex(globs).excluded(path)


def any_match(column: Column, patterns: list[str]) -> Column:
    """True if no pattern is given, or any is found in column."""
    return reduce(lambda a, b: a | b, (column.rlike(p) for p in patterns)) if patterns else F.lit(True)


def strip_relative(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")
