import hashlib
import re

from langlens.llm import decontaminate

from .docs import BASE, empty, frame

ITEMS = [
    ("b1", "the cat sat on the mat and then it left the room for good"),
    ("b2", "IT LEFT THE ROOM, for good! Second line here"),
    ("b3", "x"),
    ("b4", None),
    ("b5", " ,;. "),
    ("b6", "don't 12345"),
    ("b7", "the cat sat on the mat and then"),
]


def tokens(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]


def hits_of(text, items):
    w, hit, ids = tokens(text), set(), set()
    for name, item in items:
        g = tokens(item)
        n = min(8, len(g))
        if not n:
            continue
        windows = {tuple(g[i : i + n]) for i in range(len(g) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                ids.add(name)
    return w, hit, ids


def brute(rows, items):
    out = []
    for d, t in rows:
        w, hit, ids = hits_of(t, items)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2))
    return sorted(out, key=str)


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id string, text string")


def test_equals_brute_force(spark):
    got = [tuple(r) for r in decontaminate.contamination(frame(spark), bench(spark)).collect()]
    assert sorted(got, key=str) == brute(BASE, ITEMS)


def test_equals_brute_force_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    got = [tuple(r) for r in decontaminate.contamination(frame(spark), bench(spark)).collect()]
    assert sorted(got, key=str) == brute(BASE, ITEMS)


def test_documents_with_two_items_go(spark):
    docs = frame(spark)
    out = decontaminate.drop_contaminated(docs, bench(spark))
    assert out.columns == docs.columns
    want = [d for d, t in BASE if len(hits_of(t, ITEMS)[2]) < 2]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect())


def test_spans_go_with_the_separators_after_them(spark):
    rows = [(1, "- keep one two three four five six seven eight, keep"), (2, "nothing here"), (3, None)]
    item = [("b", "one two three four five six seven eight")]
    out = {r.doc_id: r.text for r in decontaminate.remove_spans(frame(spark, rows), bench(spark, item)).collect()}
    assert out == {1: "- keep keep", 2: "nothing here", 3: ""}


def test_empty_tables(spark):
    assert decontaminate.contamination(empty(spark), bench(spark)).count() == 0
    none = decontaminate.contamination(frame(spark), bench(spark, []))
    assert none.count() == len(BASE) and none.where("n_hit > 0 or contaminated").count() == 0
