"""The tokenizer against a scanner written by hand from the rules."""

import collections
import random
import time
import unicodedata

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from langlens.functions import tokens
from langlens.plans import queries

BLOCKS = {"/*": "*/", "{-": "-}", "(*": "*)", "<!--": "-->"}


def white(c):
    return c.isspace() and c not in "\x1c\x1d\x1e\x1f"


def numeric(c):
    return unicodedata.category(c) in ("Nd", "Nl", "No")


def letter(c):  # marks that count as alphabetic are left out; the texts here have none
    return c.isalpha() or unicodedata.category(c) == "Nl"


def scan(s):
    """(kind, open, text, close) of every token."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if white(c):
            i += 1
            continue
        mark = next((m for m in BLOCKS if s.startswith(m, i)), None)
        end = s.find(BLOCKS[mark], i + len(mark)) if mark else -1
        if end >= 0:
            out.append(("block-comment", mark, s[i + len(mark) : end], BLOCKS[mark]))
            i = end + len(BLOCKS[mark])
            continue
        if c in "#%" or s.startswith(("//", "--"), i):
            j = i
            while j < len(s) and s[j] == c:
                j += 1
            k = j
            while k < len(s) and s[k] not in "\r\n":
                k += 1
            out.append(("line-comment", s[i:j], s[j:k].lstrip(" \t"), None))
            i = k
            continue
        if c in "\"'`":
            j = i
            while j < len(s) and s[j] == c:
                j += 1
            run = j - i
            if run == 2:
                out.append(("string", c, "", c))
                i = j
                continue
            if run >= 3:
                end = s.find(s[i:j], j)
                if end >= 0:
                    out.append(("string", s[i:j], s[j:end], s[i:j]))
                    i = end + run
                    continue
            else:
                k = j
                while k < len(s) and s[k] not in (c, "\n"):
                    k += 1 if s[k] != "\\" else 2 if k + 1 < len(s) and s[k + 1] != "\n" else len(s)
                if k < len(s) and s[k] == c:
                    out.append(("string", c, s[j:k], c))
                    i = k + 1
                    continue
            out.append(("symbol", None, c, None))
            i += 1
            continue
        if numeric(c) or c in "+-" and i + 1 < len(s) and numeric(s[i + 1]):
            digits = {"0b": "01_", "0o": "01234567_", "0x": "0123456789abcdefABCDEF_"}.get(s[i : i + 2])
            if digits:
                j = i + 2
                while j < len(s) and s[j] in digits:
                    j += 1
            else:
                j, dot = i + 1, False
                while j < len(s) and (numeric(s[j]) or s[j] == "_" or s[j] == "." and not dot):
                    dot |= s[j] == "."
                    j += 1
            out.append(("number", None, s[i:j], None))
            i = j
            continue
        if letter(c) or c == "_":
            j = i
            while j < len(s) and (letter(s[j]) or s[j] == "_" or numeric(s[j])):
                j += 1
            out.append(("ident", None, s[i:j], None))
            i = j
            continue
        out.append(("symbol", None, c, None))
        i += 1
    return out


CASES = [
    "京y = x-1 + 0b01_1 0o17 0xfF_ 1.1.4", "a /* b */ c {- d -} (* e *) <!-- f --> g", "# include <x>\n//// two\r\n-- three\n%% four", "'it''s' \"a\\\"b\" `c`", "''' long\n''' \"\"",
    "/* open 'open\n\"open", "'''three", "x+y -1 +2 a-b 3-4", "<!DOCTYPE html>", "\"unterminated\\", "_a1 ²x ½ Ⅷ é9", '"""" four """" rest',
]


def test_golden_cases(spark):
    rng = random.Random(3)
    parts = ["'", '"', "`", "/*", "*/", "<!--", "-->", "#", "--", "-", "+", "\\", "\n", " ", "a", "é", "7", ".", "_", "0x", "(*", "*)", "{-", "-}", "%", "//", "京", "½"]
    texts = CASES + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens.tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert [tuple(x) for x in r.x] == scan(texts[r.i]), texts[r.i]


@pytest.mark.parametrize("name", ["tokenize_documents", "tokenize_pages"])
def test_queries_against_the_scanner(spark, name):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, getattr(queries, name)(spark, sf).collect()), key=str)
    want, chars = collections.Counter(), collections.Counter()
    if name == "tokenize_pages":
        for r in pq.read_table(f"{sf}/pages.parquet", columns=["html"]).to_pylist():
            want.update(x for k, _, x, _ in scan(r["html"] or "") if k in ("ident", "symbol") and len(x.encode()) <= 32)
        assert got == sorted(want.items(), key=str)
        return
    for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        for k, _, x, _ in scan(r["text"] or ""):
            want[r["doc_id"], k] += 1
            chars[r["doc_id"], k] += len(x)
    assert got == sorted(((*k, n, chars[k]) for k, n in want.items()), key=str)


OPENERS = [(o, c) for o, c in BLOCKS.items()]


@pytest.mark.parametrize("open_,close", OPENERS)
def test_openers_without_closers_take_linear_time(spark, open_, close):
    n = 51_200 // len(open_)
    many = [open_ * n, f"a{close}" + open_ * n, f"{open_} x {close} " + (open_ + " y ") * (n // 3), (open_ + "\n") * n, open_ * (n // 2) + close + open_ * (n // 2), "{-/*(*<!--" * 5_000]
    table = spark.createDataFrame(list(enumerate(many)), "i int, t string").coalesce(1).cache()
    table.count()
    began = time.time()
    got = {r.i: r.n for r in table.select("i", F.size(tokens.lexemes(F.col("t"))).alias("n")).collect()}
    assert time.time() - began < 1.0 * len(many)
    assert got == {i: len(scan(t)) for i, t in enumerate(many)}


def test_openers_near_closers_and_the_mark_itself(spark):
    """Openers that share characters with closers, in all orders, alone and inside of other tokens."""
    rng = random.Random(11)
    parts = ["/", "*", "(", ")", "{", "-", "}", "<", "!", ">", "/*", "*/", "(*", "*)", "{-", "-}", "<!--", "-->", '"', "'", "\\", "\n", "a", " ", "//", "7"]
    texts = ["/*/", "(*)", "{-}", "<!-->", "<!--->", "*/*", "/**/*", "*)(*", "// /* x", '"/*" (* \'(*\' *)', "-->{-<!--", "\ufdd0", "/* \ufdd0 /*", "\ufdd0 /* a */ /*"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 18))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens.tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert [tuple(x) for x in r.x] == scan(texts[r.i]), texts[r.i]
