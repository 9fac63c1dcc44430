import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from langlens.llm import bpe
from langlens.llm.common import documents, flat
from langlens.llm.tokenfiles import tokenizer

from .docs import BASE, empty, frame

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["'s", "'re", "'ll", "'", "s", "t", "re", "é", "Ü", " ", "  ", "\n", "\t", "9", "42", "!", "***", "word", "LL", "×", "東京", " ", " ", "’", "²", "\x1c", "\x00", "💡"]


def key(r):
    return (r[0] is None, r[0], *map(str, r[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_words_match_the_pattern(seed):
    rng = random.Random(seed)
    parts = PARTS[:19] if seed % 2 else PARTS
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    enc = tokenizer(VOCABULARY)
    raw, at = flat(pa.array(texts))
    start, by_doc = bpe.split_words(raw, at)
    ends = np.append(start[1:], len(raw))
    got = [[raw[a:b].tobytes() for a, b in zip(start[x:y], ends[x:y])] for x, y in zip(by_doc, by_doc[1:])]
    ranks = bpe.load_ranks(VOCABULARY)
    assert [[i for w in ws for i in bpe.merge_long(w, ranks)] for ws in got] == [enc.encode_ordinary(t) for t in texts]


def test_documents_round_trip(spark):
    enc = tokenizer(VOCABULARY)
    rng = random.Random(5)
    rows = BASE + [(100 + i, "".join(rng.choice(PARTS) for _ in range(60))) for i in range(20)] + [(200, "ab" * 5000), (201, "thtionatthesha" * 14)]
    got = bpe.assembled(documents(frame(spark, rows)), ["doc_id"], VOCABULARY).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    ids = {r.doc_id: (r.ids, r.decoded) for r in bpe.assembled(documents(frame(spark, rows)), ["doc_id"], VOCABULARY, with_ids=True).collect()}
    assert all(ids[i] == (enc.encode_ordinary(t or ""), t or "") for i, t in rows)
    assert bpe.assembled(documents(empty(spark)), ["doc_id"], VOCABULARY).collect() == []


def test_long_words_are_decoded_from_their_ids(spark, monkeypatch):
    wrong = [11, 12]
    monkeypatch.setattr(bpe, "merge_long", lambda word, ranks: wrong)
    got = bpe.assembled(documents(frame(spark, [(1, "ab" * 500)])), ["doc_id"], VOCABULARY, with_ids=True).first()
    assert (got.ids, got.decoded) == (wrong, tokenizer(VOCABULARY).decode(wrong))


def test_plans_hold_no_ranks(spark):
    """As literals the rank map and the pieces made some 2.4 MB of text of each description of the plan, which the driver keeps."""
    docs = documents(frame(spark, [(1, "some words"), (2, None)]))
    out = bpe.assembled(docs, ["doc_id"], VOCABULARY)
    out.collect()
    text = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    print(len(text))
    assert len(text) < 100_000
