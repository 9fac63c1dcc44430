import collections
import hashlib
import random

from langlens.llm import suffixdedup

from .docs import BASE, empty, frame


def brute(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for (i, _), r in zip(rows, raw):
        gone = bytearray(len(r))
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = sum(1 for k in range(len(r)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 400, 900)]
    rows = []
    for i in range(60):
        t = text(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            t += rng.choice(shared) + text(rng.randrange(40))
        rows.append((i, t))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, "ab" * 300), (201, "x" * 199), (202, "x" * 201), (203, "abc" * 67)]
    return rows


def test_repeats_of_a_collection():
    rng = random.Random(4)
    base = bytes(rng.randrange(4) for _ in range(336))
    texts = [base, base[3:300], base[:100] + b"x" + base[101:], bytes(336)[:205]]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    assert [m.tolist() for m in suffixdedup.repeats(texts)] == [[seen[t[i : i + 200]] > 1 for i in range(len(t) - 199)] for t in texts]


def test_against_brute_force(spark, monkeypatch):
    for rows in (BASE, corpus(1), corpus(2)):
        got = sorted(map(tuple, suffixdedup.dedup_bytes(frame(spark, rows)).collect()), key=str)
        assert got == brute(rows)
    assert suffixdedup.dedup_bytes(empty(spark)).collect() == []


def test_collections_against_brute_force():
    for seed in range(4):
        rng = random.Random(seed)
        base = bytes(rng.randrange(97, 100) for _ in range(330))
        texts = []
        for _ in range(40):
            x = bytearray(base)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(330)] = 120
            a = rng.randrange(60)
            texts.append(bytes(x[a : a + rng.randrange(200, 271)]))
        texts += [b"ab" * 150, b"z" * 220]
        seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        assert [m.tolist() for m in suffixdedup.repeats(texts)] == [[seen[t[i : i + 200]] > 1 for i in range(len(t) - 199)] for t in texts]


def test_long_and_low_entropy_texts(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long), (2, long[1_048_500:1_050_000]), (3, "ab" * 20_000), (4, "ba" * 150), (5, "q" * 5000), (6, "short")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixdedup.dedup_bytes(frame(spark, rows)).collect()}
    assert got == {1: (1500, 1), 2: (1500, 1), 3: (40_000, 1), 4: (300, 1), 5: (5000, 1), 6: (0, 0)}


def test_hot_seeds_are_split(spark, monkeypatch):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(150)
    tails = [text(120) for _ in range(8)]
    rows = [(i, text(rng.randrange(100)) + passage + rng.choice(tails)[: rng.randrange(40, 120)]) for i in range(60)]
    monkeypatch.setattr(suffixdedup, "HOT_PIECES", 3)
    monkeypatch.setattr(suffixdedup, "BROADCAST_PIECES", 0)
    assert sorted(map(tuple, suffixdedup.dedup_bytes(frame(spark, rows)).collect()), key=str) == brute(rows)
