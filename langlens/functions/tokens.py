"""A tokenizer for source code of any language, as one ordered alternation.

Comments, strings, numbers, identifiers and symbols; what does not close is a one-character symbol, and scanning
goes on right after it, which is how alternatives of a regular expression fail anyway. Openers of block comments after
the last of their closers are told apart before, so that none of them is scanned to the end of the text in vain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN_BYTES = 32
_N = r"\p{Nd}\p{Nl}\p{No}"
_QUOTES = {'"': "a", "'": "b", "`": "c"}
_BLOCKS = [(r"/\*", r"\*/"), (r"\{-", r"-\}"), (r"\(\*", r"\*\)"), ("<!--", "-->")]
_LINES = ["//++", "--++", "#++", "%++"]


#: Stands behind the first character of an opener that nothing closes: a code point that is no character. A text
#: that has it is taken as it is.
_OPEN = "\ufdd0"
_PAIRS = [("/*", "*/"), ("{-", "-}"), ("(*", "*)"), ("<!--", "-->")]


def _alternatives() -> list[str]:
    out = [f"{a}[\\s\\S]*?{b}" for a, b in _BLOCKS]
    out += [f"{a}[^\\r\\n]*+" for a in _LINES]
    for q, name in _QUOTES.items():
        out += [f"(?<{name}>{q}{{3,}}+)[\\s\\S]*?\\k<{name}>", f"{q}{q}(?!{q})", f"{q}(?!{q})[^{q}\\\\\\n]*+(?:\\\\[^\\n][^{q}\\\\\\n]*+)*+{q}"]
    out += ["0b[01_]*+", "0o[0-7_]*+", "0x[0-9a-fA-F_]*+", f"[+-]?[{_N}][{_N}_]*+(?:\\.[{_N}_]*+)?", f"[\\p{{IsAlphabetic}}_][\\p{{IsAlphabetic}}{_N}_]*+", r"[^\p{IsWhite_Space}]"]
    return out


PATTERN = "(" + "|".join(_alternatives()) + ")"


#: The same for texts with _OPEN, which is skipped like a blank.
_MARKED = PATTERN.replace(r"[^\p{IsWhite_Space}]", rf"[^\p{{IsWhite_Space}}{_OPEN}]")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _hopeless_marked(text: Column) -> Column:
    """The text with _OPEN in every opener of a block comment that has no closer after it: those that end after the
    start of the last closer."""

    def mark(open_: str, close: str) -> Callable[[Column], Column]:
        def one(t: Column) -> Column:
            back = F.instr(F.reverse(t), F.lit(close[::-1]))
            last = F.when(back > 0, F.length(t) - back - len(close) + 2).otherwise(0)
            first = F.greatest(F.lit(1), last - len(open_) + 1)  # from here on, counted from 1, openers are hopeless
            tail = F.replace(F.substring(t, first, F.length(t)), F.lit(open_), F.lit(open_[0] + _OPEN + open_[1:]))
            return F.when(F.contains(t, F.lit(open_)), F.concat(F.substring(t, F.lit(1), first - 1), tail)).otherwise(t)

        return one

    for pair in _PAIRS:
        text = _let(text, mark(*pair))
    return text


def lexemes(text: Column) -> Column:
    """array<string> of the tokens' texts, in order."""
    every = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), 1)
    found = lambda t: F.when(F.contains(t, F.lit(_OPEN)), F.transform(every(t, _MARKED), lambda x: F.translate(x, _OPEN, ""))).otherwise(every(t, PATTERN))
    return F.when(F.contains(text, F.lit(_OPEN)), every(text, PATTERN)).otherwise(_let(_hopeless_marked(text), found))


def kind(lexeme: Column) -> Column:
    """ident, number, line-comment, block-comment, string or symbol, by the first characters; only characters beyond
    ASCII need their Unicode class."""
    long = F.length(lexeme) > 1
    first, two = F.substring(lexeme, 1, 1), F.substring(lexeme, 1, 2)
    ascii_ = first < "\x80"
    return (
        F.when(long & (two.isin("/*", "{-", "(*") | (two == "<!")), "block-comment")
        .when(first.isin("#", "%") | two.isin("//", "--"), "line-comment")
        .when(long & first.isin(*_QUOTES), "string")
        .when(first.between("0", "9") | (long & first.isin("+", "-")), "number")
        .when(long & ascii_ | first.between("a", "z") | first.between("A", "Z") | (first == "_"), "ident")
        .when(ascii_, "symbol")
        .when(lexeme.rlike(f"^[{_N}]"), "number")
        .when(lexeme.rlike(r"^\p{IsAlphabetic}"), "ident")
        .otherwise("symbol")
    )


def tokens(text: Column) -> Column:
    """array<struct<kind, open, text, close>>; open and close are the marks of comments and strings."""

    def token(t: Column) -> Column:
        k, x = t["k"], t["x"]
        run = F.length(x) - F.length(F.ltrim(x, F.substring(x, 1, 1)))  # how often the first character stands there
        page = F.substring(x, 1, 2) == "<!"
        size = F.when(k == "block-comment", F.when(page, 4).otherwise(2)).when(k == "line-comment", run).when(k == "string", F.when(run > 2, run).otherwise(1))
        open_ = F.substring(x, F.lit(1), size)
        close = F.when(k == "block-comment", F.when(page, "-->").otherwise(F.substring(x, -2, 2))).when(k == "string", open_)
        inner = F.substring(x, size + 1, F.length(x) - size - F.coalesce(F.length(close), F.lit(0)))
        body = F.when(k == "line-comment", F.ltrim(inner, F.lit(" \t"))).when(k.isin("block-comment", "string"), inner).otherwise(x)
        return F.struct(k.alias("kind"), open_.alias("open"), body.alias("text"), close.alias("close"))

    return F.transform(F.transform(lexemes(text), lambda x: F.struct(kind(x).alias("k"), x.alias("x"))), token)


def key_tokens(text: Column, max_bytes: int = MAX_TOKEN_BYTES) -> Column:
    """array<string>: identifiers and symbols of at most max_bytes bytes, what the classifier counts."""
    return F.filter(lexemes(text), lambda x: kind(x).isin("ident", "symbol") & (F.octet_length(x) <= max_bytes))
