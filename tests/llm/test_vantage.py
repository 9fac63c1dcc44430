import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from langlens.llm import vantage

SF = "/root/testdata/sf0.01/embeddings.parquet"


def frame(spark, rows, parts=3, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({n: F.lit(n) for n in ("rid", "cell", "v", "score", "a.b")}).repartition(parts)


def exact(rows, every=20, k=20):
    """(query row, rank, vec_id, score), by comparing everything; rows without null ids."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % every == 0:
            found = sorted((-np.cumsum(q * v)[-1], j) for other, (j, v) in enumerate(ok) if other != at)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def as_floats(x):
    return [(i, [float(v) for v in row]) for i, row in enumerate(np.asarray(x, np.float32))]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_ROWS", 64)
    monkeypatch.setattr(vantage, "LEAF", 8)
    monkeypatch.setattr(vantage, "QUERY_ROWS", 16)


def kinds(n=600):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 6))
    clusters = rng.standard_normal((8, 6))[rng.integers(0, 8, n)] * 5 + rng.standard_normal((n, 6))
    copies = np.where(np.arange(n)[:, None] % 3 == 0, x[0], np.round(x))
    return {"normal": x, "unit": x / np.linalg.norm(x, axis=1)[:, None], "clusters": clusters, "copies": copies, "one": np.ones((n, 6)), "one long": np.where(np.arange(n)[:, None] == 77, 1e6, x)}


@pytest.mark.parametrize("kind", kinds())
def test_factor_one_is_exact(spark, small, kind):
    rows = as_floats(kinds()[kind])
    assert got(vantage.neighbours(frame(spark, rows), factor=1.0)) == exact(rows)


def test_rows_that_take_no_part(spark, small):
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [math.nan, 1.0]), (120, [math.inf, 1.0]), (140, [-3.0, 0.5]), (140, [-3.0, 0.5]), (5, [1.0, 2.0]), (160, [1e300, 1.0])]
    assert got(vantage.neighbours(frame(spark, rows, kind="double"), factor=1.0)) == exact(rows)
    other = [*rows, (180, [1.0, 2.0, 3.0])]  # not of the most frequent length
    assert got(vantage.neighbours(frame(spark, other, kind="double"), factor=1.0)) == exact(rows)
    last = got(vantage.neighbours(frame(spark, [(0, [1.0]), (None, [2.0]), (7, [2.0])])))
    assert last == [(0, 1, 7, 2.0), (0, 2, None, 2.0)]


def test_empty_table_and_single_row(spark):
    assert got(vantage.neighbours(frame(spark, []))) == [] and got(vantage.neighbours(frame(spark, [(0, [1.0])]))) == []


def test_recall_at_the_default_factor(spark):
    table = spark.read.parquet(SF)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found, want = got(vantage.op12_vantage_search(spark, SF.rsplit("/", 1)[0])), exact(rows)
    assert len(found) == len(want) and len({(a, b) for a, b, *_ in found}) == len(found)
    assert len({(a, c, s) for a, _, c, s in found} & {(a, c, s) for a, _, c, s in want}) >= 0.9 * len(want)


@pytest.mark.parametrize("scale", [False, True])
def test_recall_on_vectors_without_structure(spark, monkeypatch, scale):
    """Independent components of 32 dimensions, where the triangle inequality says least."""
    monkeypatch.setattr(vantage, "SHARD_ROWS", 512)
    monkeypatch.setattr(vantage, "LEAF", 32)
    x = np.random.default_rng(8).standard_normal((4000, 32))
    rows = as_floats(x if scale else x / np.linalg.norm(x, axis=1)[:, None])
    found, want = got(vantage.neighbours(frame(spark, rows))), exact(rows)
    assert len(found) == len(want) and len({(a, c) for a, _, c, _ in found} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)


def test_a_larger_factor_asks_for_less():
    x = np.random.default_rng(2).standard_normal((3000, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    reach = float(np.linalg.norm(x, axis=1).max())
    order, ranges = vantage.tree_order(x, reach)
    asked = []
    for factor in (1.0, 4.0):
        shard = vantage.Shard(x[order], order, order, ranges, reach)
        shard.search(x[:50], np.arange(50), np.full(50, -np.inf), 10, factor)
        asked.append(shard.asked)
    assert asked[1] < asked[0] < 0.7 * 50 * 3000
