import hashlib
import random

import public_tokenizers

import corpus_pipeline
from langlens.llm import quality
from langlens.llm.tokenfiles import tokenizer

from .docs import SCHEMA
from .test_jaccard import brute as near
from .test_linededup import within_one


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(word() for _ in range(14))) for i in range(6)]
    good = ["\n".join(line(12) for _ in range(4)) for _ in range(30)]
    bad = [" ".join("#$%&@"[rng.randrange(5)] * rng.randrange(1, 4) for _ in range(40)) for _ in range(20)]
    texts = good + bad
    texts += [good[0], good[1].replace(good[1].split()[5], "changed", 1), good[2] + "\n" + good[3].split("\n")[0], good[4][:-1]]
    texts += [f"{line(12)}\n{items[0][1]}\n{line(9)} {items[1][1]}", f"{line(12)}\n{items[2][1]}", None, ""]
    rows = list(enumerate(texts))
    return rows, items, [(i, int(i < 30), 0) for i in range(50)]


def plain(model, rows, items):
    import pyarrow as pa
    from langlens.llm.common import RollingHash

    score = quality.score_texts(model, pa.array([t or "" for _, t in rows]), RollingHash())
    rows = [r for r, s in zip(rows, score) if s >= 0.3]
    seen, out = [], []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            if not x.strip() or not any(within_one(x, y) for y in seen):
                kept.append(x)
            if x.strip():
                seen.append(x)
        if len(kept) == len(lines) or any(x.strip() for x in kept):
            out.append((i, t if len(kept) == len(lines) else "\n".join(kept)))
    names = {i: c for i, _, c in near(out)}
    out = [r for r in out if names[r[0]] == r[0]]
    windows = {tuple(w[k : k + 8]): i for i, t in items for w in [t.split()] for k in range(len(w) - 7)}

    def leaks(t):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        return len({windows[x] for k in range(len(w) - 7) if (x := tuple(w[k : k + 8])) in windows}) >= 2

    enc = tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary
    return sorted((i, "x", enc(t or ""), len(enc(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in out if not leaks(t))


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rows, items, labels = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", k1 string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "k1", "ids", "n_tokens", "decoded_sha256"]
    want = plain(quality.train_quality(docs, labelled), rows, items)
    assert 20 < len(want) < 45
    assert sorted(map(tuple, got.collect())) == want
