import hashlib
import random

from pyspark.sql import functions as F

from langlens.llm import linededup

from .docs import BASE, empty, frame

NEAR = [
    (20, "a line of more than twenty characters\nanother line that is long enough here"),
    (21, "a line of more than twenty charakters\nanother line that is long enough her\nshort line"),
    (22, "short line\nshort lone\nline of more than twenty characters\n\n"),
    (23, "another line that is long enough herex\nxanother line that is long enough here"),
]


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    lines = [word(rng.choice([1, 2, 3, 5, 9, 30])) for _ in range(30)]

    def edited(x):
        i = rng.randrange(len(x))
        return rng.choice([x, x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x[:i] + "z" + x[i + 1 :]])

    return [(i, "\n".join(edited(rng.choice(lines)) for _ in range(rng.randrange(4)))) for i in range(60)]


def brute(rows):
    texts = sorted({(d, t or "") for d, t in rows if d is not None})
    lines = [(d, no, x) for d, t in texts for no, x in enumerate(t.split("\n")) if x.strip()]
    gone = set()
    for i, (d, no, x) in enumerate(lines):
        if any(within_one(x, y) for _, _, y in lines[:i]):
            gone.add((d, no))
    out = []
    for d, t in rows:
        if d is not None:
            all_lines = (t or "").split("\n")
            kept = [x for no, x in enumerate(all_lines) if (d, no) not in gone]
            out.append((d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark):
    for rows in ([r for r in BASE + NEAR if r[0] is not None], corpus(1), corpus(2)):
        out = linededup.dedup_lines(frame(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out) == brute(rows)


def test_blocks_and_shuffled_places_give_the_same(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(linededup, "BLOCK", 2)
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    out = linededup.dedup_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out) == brute(rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one line", 5, "a", 8), (2, "one line", 6, "b", 8)], "doc_id long, text string, k1 int, keep string, n_chars int").withColumns({"row": F.lit(1), "l": F.lit("x")})
    out = linededup.rewrite(docs)
    assert out.schema == docs.schema and [tuple(r) for r in out.collect()] == [(1, "one line", 5, "a", 8, 1, "x")]


def test_a_very_long_line(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(40_000))
    rows = [(1, long), (2, long[:30_000] + "#" + long[30_001:]), (3, "!" + long), (4, long[1:]), (5, long[::-1])]
    out = {r.doc_id: r.n_removed for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


def test_rewrite_keeps_columns_and_drops_what_is_left_blank(spark):
    rows = [(1, "the same line of text, twice over"), (2, "the same line of text, twice over"), (3, "\n"), (4, None)]
    docs = frame(spark, rows)
    out = linededup.rewrite(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_null_id_and_empty_table(spark):
    assert linededup.dedup_lines(frame(spark, [(None, "one line"), (None, None)])).count() == 2
    assert linededup.dedup_lines(empty(spark)).count() == 0
