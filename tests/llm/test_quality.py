import itertools
import zlib

import numpy as np
import pyarrow as pa

from langlens.llm import quality
from langlens.llm.common import RollingHash, flat

from .docs import BASE, empty, frame


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    score, trans = rng.normal(0, 1, len(doc)), rng.normal(0, 1, (2, 2))
    got, moves, logz = quality.forward_backward(score, doc, trans)
    want, want_moves, want_z = np.zeros(len(doc)), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        weight = np.array([np.exp(sum(score[i] * y for i, y in zip(at, p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        want_z += np.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            want[at] += w * np.array(p)
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w
    assert np.allclose(got, want) and np.allclose(moves, want_moves) and np.isclose(logz, want_z)


def test_pieces_change_no_feature(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abC 1.!\n"), 700)) for _ in range(5)] + ["", "x" * 500, "\n\n", "one\ntwo three\n" * 40]
    raw, at = flat(pa.array(texts))
    whole = quality.line_features(raw, at, RollingHash())
    for size in (16, 100, 333):
        monkeypatch.setattr(quality, "STEP_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, quality.line_features(raw, at, RollingHash())))


def test_features_see_the_neighbours():
    raw, at = flat(pa.array(["Good line here.\n@@@@ #### !!!!\nGood line here."]))
    _, _, active = quality.line_features(raw, at, RollingHash())
    k, base = len(quality._CUTS), quality.N_BINS + 1
    assert np.array_equal(active[1, k : 2 * k] - base, active[0, :k]) and np.array_equal(active[1, 2 * k :] - 2 * base, active[2, :k])
    assert (active[0, k : 2 * k] - base == quality.N_BINS).all()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op5_quality_classifier(spark, sf).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].predicted, q) for i, q in truth.items() if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum(a == b for a, b in held) > 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())


def test_odd_rows_and_labels(spark):
    docs = frame(spark).withColumnRenamed("slot", "score")
    for rows, prior in (([], 0.5), ([(i, 1, 0) for i in range(1, 11)], None), ([(None, 1, 0), (1, None, 0)], 0.5)):
        out = quality.score_quality(docs, quality.train_quality(docs, labels(spark, rows))).collect()
        assert len(out) == len(BASE) and len({r.score for r in out}) == 1
        assert prior is None or out[0].score == prior
        assert [r.held_out for r in out if r.doc_id is None] == [None]
    model = quality.fit(["fine words here.", "#!# @@@ $$"] * 4, [1, 0] * 4)
    assert quality.score_quality(empty(spark), model).collect() == []
    kept = quality.filter_quality(docs, model)
    assert kept.schema == docs.schema


def test_hot_ids_teach_once(spark):
    docs = frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, "other")])
    model = quality.train_quality(docs, labels(spark, [(i, 1, 0) for i in range(30)]))
    assert 0.5 < model["prior"] <= 0.75
