"""Every operator on a table with clashing columns, nulls, repeated rows, and ids that are strings."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from langlens.llm import bpe, decontaminate, jaccard, linededup, media, quality, recurrent, suffixdedup, tokenfiles
from langlens.llm.common import documents

from .docs import BASE

NAMES = "k1 k2 row l keep out h h2 v s n c d g lo own sid root items hits place words numbers block bucket codes decoded ids score predicted held_out spans copies w bad key base part rest x shard data file ordinal slot n_tokens".split()
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def contaminated(docs):
    return decontaminate.contamination(docs, docs.sparkSession.createDataFrame([(1, "cat sat on the mat and then it"), (2, None)], "item_id long, text string"))


def shards(docs, folder):
    return tokenfiles.training_shards(docs, folder, key=1, length=1 << 14)


OPERATORS = [
    lambda docs, _: suffixdedup.dedup_bytes(docs), lambda docs, f: shards(docs, f), lambda docs, _: linededup.dedup_lines(docs), lambda docs, _: bpe.assembled(docs, ["doc_id"], VOCABULARY),
    lambda docs, _: quality.score_quality(docs, quality.fit(["good words", "#"], [1, 0])), lambda docs, _: contaminated(docs), lambda docs, _: recurrent.score_documents(docs), lambda docs, _: jaccard.near_duplicates(docs),
    lambda docs, _: media.media_digests(docs), lambda docs, f: tokenfiles.export_tokens(docs, f, VOCABULARY),
]


@pytest.mark.parametrize("number", range(1, 11))
def test_clashing_columns_and_string_ids(spark, tmp_path, number):
    rows = [(None if i is None else f"id{i}", t) for i, t in BASE]
    spark.createDataFrame(rows, "doc_id string, text string").withColumns({n: F.lit(n) for n in NAMES}).repartition(2).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    out = OPERATORS[number - 1](docs, f"file://{tmp_path}/files")
    assert sorted((r.doc_id or "" for r in out.select("doc_id").collect())) == sorted(i or "" for i, _ in rows)


def test_stages_keep_clashing_columns(spark):
    docs = spark.createDataFrame(BASE, "doc_id long, text string").withColumns({n: F.lit(n) for n in NAMES})
    items = spark.createDataFrame([(1, "none of these words")], "item_id long, text string")
    for stage in (linededup.rewrite, jaccard.keep_one, lambda x: decontaminate.drop_contaminated(x, items), lambda x: quality.filter_quality(x, quality.fit([], []))):
        out = stage(docs)
        assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(NAMES)}
    kept = bpe.assembled(documents(docs), ["doc_id"], VOCABULARY, with_ids=True)
    assert kept.count() == len(BASE)


def test_names_with_dots(spark):
    docs = spark.createDataFrame(BASE, "doc_id long, text string").withColumns({"a.b": F.lit("dot"), "c d": F.lit("tick")})
    items = spark.createDataFrame([(1, "none of these words")], "item_id long, text string")
    for stage in (linededup.rewrite, jaccard.keep_one, lambda x: decontaminate.drop_contaminated(x, items), lambda x: quality.filter_quality(x, quality.fit([], []))):
        out = stage(docs)
        assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {("dot", "tick")}
    out = bpe.assembled(docs, ["doc_id", "a.b", "c d"], VOCABULARY)
    assert out.count() == len(BASE) and out.columns[:3] == ["doc_id", "a.b", "c d"]


def thue_morse(n):
    """Complementary words of the sequence: polynomial hashes modulo a power of two collide for them."""
    word = "ab"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_regular_texts_are_told_apart(spark):
    rows = [(10 * i + j, word) for i, n in enumerate((1024, 2048, 4096)) for j, word in enumerate(thue_morse(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.decoded_sha256 for r in bpe.assembled(docs, ["doc_id"], VOCABULARY).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {i: i for i, _ in rows}
    assert jaccard.keep_one(docs).count() == len(rows)
    for _, text in rows:
        raw = np.frombuffer(f"{text} {rows[0][1]}".encode(), np.uint8)
        ids, _ = recurrent.tokens(raw, np.array([0, len(raw)]))
        assert (ids[0] == ids[1]) == (text == rows[0][1])


def test_folds_of_fractional_ids(spark):
    """The fold of an id is that of its text in Spark, for learning and for the answer."""
    rows = [(float(10**i + i), "good words here") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id double, text string")
    text = F.col("doc_id").cast("string").cast("binary")
    for out, n, k in ((quality.score_quality(docs, quality.fit([], [])), 5, 0), (recurrent.score_documents(docs), 7, 2)):
        assert out.where(F.col("held_out") != (F.crc32(text) % n == k)).count() == 0 and out.count() == 12
