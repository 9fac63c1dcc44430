"""Contents: UTF-8 validity, truncation, and shebang lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 51200


def literal(value: str) -> str:
    """A string as a literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_text(content: Column) -> Column:
    """Binary content as a string; null if it is no valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def truncated(text: Column, n: int = MAX_BYTES) -> Column:
    """The first n bytes, cut back to a character boundary (valid input loses at most 3 bytes more)."""
    raw = text.cast("binary")
    cut = [F.substring(raw, 1, k).cast("string") for k in range(n, n - 4, -1)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(c), c) for c in cut)))


def interpreter(text: Column) -> Column:
    """The interpreter that a first line #!... names; null if there is none.

    env passes on to its first argument, sh to a command that one of the next four lines execs with "$0" and "$@";
    a version at the end is dropped, so python2.6.3 gives python."""
    first = F.regexp_replace(F.regexp_extract(text, r"\A([^\n]*)", 1), r"\r\z", "")
    words = F.filter(F.split(F.element_at(F.split(first, "/"), -1), r"[\s\x0B]+"), lambda w: w != "")
    command = F.when(F.get(words, 0) == "env", F.get(words, 1)).otherwise(F.get(words, 0))
    hack = F.regexp_extract(F.array_join(F.transform(F.slice(F.split(text, "\n"), 2, 4), lambda x: x), "\n"), r"exec (\w+).+\$0.+\$@", 1)
    command = F.when(command == "sh", F.coalesce(F.nullif(hack, F.lit("")), F.lit("sh"))).otherwise(command)
    return F.when(F.startswith(first, F.lit("#!")), F.get(F.split(command, r"[0-9]\.[0-9]"), 0))
