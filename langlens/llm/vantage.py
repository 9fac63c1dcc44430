"""Approximate nearest neighbours by largest inner product: vantage-point trees per shard.

Inner products become distances by one more component: a row x has sqrt(M^2 - |x|^2), M the largest norm, a query 0; then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, and the triangle inequality holds.

1. A top tree over a bounded sample (SAMPLE rows, by hash of their numbers) splits space into cells; every row goes down
   it into its cell. Cells are shards; one with more than SHARD_ROWS rows, as copies make it, is dealt over several.
2. Each shard's rows are put in the order of a vantage-point tree: a vantage point, then its nearer half, then its
   farther half, with the range of distances of each half; ends of LEAF rows have no further points. The index is
   that table of all rows.
3. A query asks the shards of its own cell first, then, with the k-th score found there, the shards of the cells that
   the top tree can't rule out. A half or a cell is ruled out if `factor` times its least possible distance is beyond
   the k-th best: at factor 1 that is exact, larger factors visit less and may miss neighbours.
4. Scores are inner products in double precision, added from the first component on, so copies tie exactly; each
   shard's best k, then the best k of all, nearest first, ties to the smaller vec_id, null ids last.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those whose length is
not the most frequent one (the larger among equals). Rows that repeat are candidates and queries of their own: only the
query's own row is left out. A table without vectors gives no rows. Other columns are ignored, whatever their names.

The factor is a parameter; by default the largest one of FACTORS whose recall on the bounded sample is TARGET or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, written

K = 20
#: Rows that the top tree is fitted on.
SAMPLE = 16_384
SHARD_ROWS = 4096
#: Rows of the sample that an end of the top tree has at least.
CELL_SAMPLE = 8
LEAF = 256
#: Queries that one task holds at once for a shard.
QUERY_ROWS = 1 << 16
#: Factors that are tried, largest first, until the recall on the sample's own nearest rows is TARGET at least; else 1. It is
#: measured with TUNE_QUERIES of TUNE_ROWS rows of the sample.
FACTORS = (8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.25)
TARGET, TUNE_QUERIES, TUNE_ROWS = 0.98, 256, 8192
#: Distances are told apart beyond this share of the largest one.
SLACK = 1e-6


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with the rows of y, added from the first component on."""
    return np.cumsum(x * y, axis=1)[:, -1]


def _distances(scores: np.ndarray, own: np.ndarray | float, reach: float) -> np.ndarray:
    """Distances in the space with one more component, of rows or queries of squared norm `own` from a row, by scores."""
    return np.sqrt(np.maximum(own + reach * reach - 2 * scores, 0))


def _between(x: np.ndarray, point: np.ndarray, reach: float) -> np.ndarray:
    """Distances of rows from a row, both with their one more component."""
    more = lambda v: np.sqrt(np.maximum(reach * reach - (v * v).sum(-1), 0))
    return np.sqrt(np.maximum(((x - point) ** 2).sum(-1) + (more(x) - more(point)) ** 2, 0))


class TopTree:
    """A tree over a sample, in the order of a heap: node i has the vantage point points[i]; rows nearer than or as near as
    radii[i] go to 2i + 1, others to 2i + 2. Ends are cells."""

    def __init__(self, sample: np.ndarray, cells: int, reach: float) -> None:
        self.reach, self.depth = reach, 0
        while 1 << self.depth < cells and len(sample) >> (self.depth + 1) >= CELL_SAMPLE:
            self.depth += 1
        n = (1 << self.depth) - 1
        self.points, self.radii = np.zeros((n, sample.shape[1])), np.zeros(n)
        members = {0: np.arange(len(sample))}
        for i in range(n):
            mine = members.pop(i)
            far = _between(sample[mine], sample[mine[0]], reach)
            point = sample[mine[np.argmax(far)]]  # at the rim, where halves differ most
            far = _between(sample[mine], point, reach)
            order = np.argsort(far, kind="stable")
            half = len(mine) // 2
            self.points[i], self.radii[i] = point, far[order[max(half - 1, 0)]]
            members[2 * i + 1], members[2 * i + 2] = mine[order[:half]], mine[order[half:]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            for i in np.unique(node):
                mine = np.flatnonzero(node == i)
                node[mine] = 2 * i + 1 + (_between(x[mine], self.points[i], self.reach) > self.radii[i])
        return node - len(self.radii)

    def least(self, q: np.ndarray) -> np.ndarray:
        """The least possible distance of each query from the rows of each cell."""
        low = np.zeros((len(q), 1 << self.depth))
        if self.depth:
            d = _distances(q @ self.points.T, (q * q).sum(1)[:, None], self.reach)
            for i in range(len(self.radii)):
                level = (i + 1).bit_length() - 1
                width = 1 << (self.depth - level)
                a = (i + 1 - (1 << level)) * width
                gap = (d[:, i] - self.radii[i])[:, None]
                low[:, a : a + width // 2] = np.maximum(low[:, a : a + width // 2], gap)
                low[:, a + width // 2 : a + width] = np.maximum(low[:, a + width // 2 : a + width], -gap)
        return low


def tree_order(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a shard in the order of its vantage-point tree, and of each place the ranges of distances of the nearer
    and the farther half after it (NaN where no halves follow)."""
    order, ranges = np.arange(len(x)), np.full((len(x), 4), np.nan)
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            continue
        mine = order[lo:hi]
        far = _between(x[mine], x[mine[0]], reach)
        top = int(np.argmax(far))
        mine[[0, top]] = mine[[top, 0]]
        far = _between(x[mine[1:]], x[mine[0]], reach)
        by = np.argsort(far, kind="stable")
        order[lo + 1 : hi], far = mine[1:][by], far[by]
        mid = (len(far) + 1) // 2
        ranges[lo] = far[0], far[mid - 1], far[mid], far[-1]
        todo += [(lo + 1, lo + 1 + mid), (lo + 1 + mid, hi)]
    return order, ranges


class Shard:
    """A shard's rows in tree order, and the search in it for many queries at once."""

    def __init__(self, x: np.ndarray, row: np.ndarray, ident: np.ndarray, ranges: np.ndarray, reach: float) -> None:
        self.x, self.row, self.ident, self.ranges, self.reach = x, row, ident, ranges, reach
        self.asked = 0  # pairs of queries and rows whose scores were asked for

    def search(self, q: np.ndarray, own_row: np.ndarray, floor: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        """scores, ids and rows (-1: none) of the k best of each query that reach its floor."""
        n = len(q)
        self.q, self.own_row, self.k, self.factor = q, own_row, k, factor
        self.norm = (q * q).sum(1)
        self.scores = np.full((n, k), -np.inf)
        self.ids, self.rows = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        self.floor = floor.astype(float)
        with np.errstate(over="ignore", invalid="ignore"):  # components near the largest number
            self._visit(0, len(self.x), np.arange(n))
        return self.scores, self.ids, self.rows

    def _kth(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[who], self.scores[who, -1])

    def _offer(self, lo: int, hi: int, who: np.ndarray, approx: np.ndarray) -> None:
        """Rows lo to hi for some queries: those that may reach the k-th score are scored exactly and kept."""
        self.asked += approx.size
        margin = 1e-9 * (1 + self.reach * np.sqrt(self.norm[who]))
        bar = self._kth(who) - margin
        some = np.flatnonzero(approx.max(1) >= bar)
        if not len(some):
            return
        who, approx, bar, margin = who[some], approx[some], bar[some], margin[some]
        approx = np.where(self.row[lo:hi][None, :] == self.own_row[who][:, None], -np.inf, approx)
        if hi - lo > self.k:  # the k best here leave out what is worse
            bar = np.maximum(bar, np.partition(approx, hi - lo - self.k, axis=1)[:, hi - lo - self.k] - 2 * margin)
        i, j = np.nonzero((approx >= bar[:, None]) & (approx > -np.inf))
        count = np.bincount(i, minlength=len(who))
        place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        shape = (len(who), int(count.max()) if len(i) else 0)
        scores, ids, rows = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -1)
        scores[i, place] = exact_scores(self.q[who[i]], self.x[lo + j])
        ids[i, place], rows[i, place] = self.ident[lo + j], self.row[lo + j]
        scores, ids, rows = (np.concatenate([a[who], b], 1) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        best = np.lexsort((rows, ids, -scores), axis=1)[:, : self.k]
        self.scores[who], self.ids[who], self.rows[who] = (np.take_along_axis(a, best, 1) for a in (scores, ids, rows))

    def _visit(self, lo: int, hi: int, who: np.ndarray) -> None:
        if not len(who):
            return
        if hi - lo <= LEAF:
            self._offer(lo, hi, who, self.q[who] @ self.x[lo:hi].T)
            return
        near_lo, near_hi, far_lo, far_hi = self.ranges[lo]
        to_point = self.q[who] @ self.x[lo]
        self._offer(lo, lo + 1, who, to_point[:, None])
        d = _distances(to_point, self.norm[who], self.reach)
        mid = lo + 1 + (hi - lo) // 2
        near = (lo + 1, mid, np.maximum(near_lo - d, d - near_hi))
        far = (mid, hi, np.maximum(far_lo - d, d - far_hi))
        first = near[2] <= far[2]
        for (a, b, gap), mine in ((near, first), (far, ~first), (far, first), (near, ~first)):
            some = np.flatnonzero(mine)
            kth = self._kth(who[some])
            with np.errstate(invalid="ignore"):
                out = _distances(np.where(kth > -np.inf, kth, 0), self.norm[who[some]], self.reach)
            reach = np.where(kth > -np.inf, out, np.inf) + SLACK * (self.reach + np.sqrt(self.norm[who[some]]))
            self._visit(a, b, who[some[self.factor * gap[some] <= reach]])


def tuned_factor(sample: np.ndarray, reach: float, k: int = K) -> float:
    """The largest factor whose recall on the sample reaches TARGET, or 1."""
    x = sample[:TUNE_ROWS]
    own = np.arange(0, len(x), max(1, len(x) // TUNE_QUERIES))
    order, ranges = tree_order(x, reach)
    shard = Shard(x[order], order, order, ranges, reach)
    floor = np.full(len(own), -np.inf)
    true = shard.search(x[own], own, floor, k, 1.0)[0]
    for factor in FACTORS:
        found = shard.search(x[own], own, floor, k, factor)[0]
        if (found >= true - 1e-12 * reach * reach).mean() >= TARGET:
            return factor
    return 1.0


def _finite(v: Column) -> Column:
    """The vector where it takes part, else null."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(F.forall(v, ok) & F.exists(v, lambda x: x != 0), v)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _ranges(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


_FOUND = "number long, query_id long, rid long, vec_id long, score double"


class Index:
    """The index of a table of vectors: `rows` has cell, part, place, rid, vec_id, v and ranges of every row that takes part."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        spark = vectors.sparkSession
        every = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), _finite(F.col(vector_col)).alias("v")).where("v is not null")
        kind = every.schema["v"].dataType.simpleString()
        norm = F.aggregate("v", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
        sizes = every.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(norm).alias("norm")).orderBy(F.desc("rows"), F.desc("n")).first()
        self.tree, self.reach, self.dims, self.factor = None, 0.0, 0, 1.0
        self.rows = spark.createDataFrame([], f"cell long, part long, place long, rid long, vec_id long, v {kind}, ranges array<double>")
        if sizes is None:
            return
        self.dims, self.reach = sizes["n"], float(np.sqrt(sizes["norm"]) * (1 + 1e-9))
        every = every.where(F.size("v") == self.dims)
        sample = every.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("v").collect()  # SAMPLE rows at most
        sample = np.array([r.v for r in sample], np.float64)
        tree, self.factor = TopTree(sample, -(-sizes["rows"] // SHARD_ROWS), self.reach), tuned_factor(sample, self.reach)
        self.tree = tree

        def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(tree.cells(_matrix(b[2]))), *b.columns], ["cell", "rid", "vec_id", "v"])

        # Stored, so that a row keeps its number in every job.
        dealt = written(every.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v").mapInArrow(celled, f"cell long, rid long, vec_id long, v {kind}"), "cells")
        self.parts = np.ones(1 << tree.depth, np.int64)
        for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell: SAMPLE / CELL_SAMPLE at most
            self.parts[r.cell] = -(-r.n // SHARD_ROWS)
        part = F.pmod(F.xxhash64("rid"), F.get(F.array(*map(F.lit, self.parts.tolist())), F.col("cell").cast("int")))
        reach, names = self.reach, self.rows.columns

        def ordered(table: pa.Table) -> pa.Table:
            table = table.sort_by("rid").combine_chunks()
            order, ranges = tree_order(_matrix(table["v"].combine_chunks()), reach)
            table = table.take(pa.array(order))
            return table.append_column("place", pa.array(np.arange(len(order)))).append_column("ranges", _ranges(ranges)).select(names)

        self.rows = written(dealt.withColumn("part", part).groupBy("cell", "part").applyInArrow(ordered, self.rows.schema), "index")

    def search(self, queries: DataFrame, k: int = K, factor: float | None = None) -> DataFrame:
        """query_id, rank, vec_id, score of queries (query_id, q, rid: the number of the query's own row, or null)."""
        factor = factor or self.factor
        if self.tree is None:
            return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = queries.select("query_id", _finite(F.col("q")).alias("q"), F.coalesce("rid", F.lit(-1)).alias("own"), F.lit(float("-inf")).alias("floor")).where(F.size("q") == self.dims)
        asked = written(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
        blocks = max(1, -(-asked.count() // QUERY_ROWS))
        first = written(self._met(self._routed(asked, True, blocks, factor), blocks, k, factor), "near")
        kth = first.groupBy("number").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        again = asked.join(kth, "number", "left").withColumn("floor", F.coalesce("kth", "floor"))
        rest = self._met(self._routed(again, False, blocks, factor), blocks, k, factor)
        return _best(first.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def _routed(self, asked: DataFrame, own: bool, blocks: int, factor: float) -> DataFrame:
        """Each query with the shards of its own cell, or of the other cells that its floor doesn't rule out."""
        tree, parts, kind = self.tree, self.parts, asked.schema["q"].dataType.simpleString()
        names = ["number", "query_id", "own", "floor", "q"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    b = batch.slice(lo, 1024)
                    q, floor = _matrix(b[4]), np.asarray(b[3])
                    low = tree.least(q)
                    home = np.zeros(low.shape, bool)
                    home[np.arange(len(q)), np.argmin(low, 1)] = True
                    norm = (q * q).sum(1)
                    known = np.isfinite(floor)
                    far = np.where(known, _distances(np.where(known, floor, 0), norm, tree.reach), np.inf) + SLACK * (tree.reach + np.sqrt(norm))
                    i, cell = np.nonzero(home if own else ~home & (factor * low <= far[:, None]))
                    n = parts[cell]
                    at = np.repeat(np.arange(len(i)), n)
                    out = b.take(pa.array(i[at]))
                    block = (mix(np.asarray(out[0]).astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
                    part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(part), pa.array(block), *out.columns], ["cell", "part", "block", *names])

        return asked.select(*names).mapInArrow(run, f"cell long, part long, block long, number long, query_id long, own long, floor double, q {kind}")

    def _met(self, routed: DataFrame, blocks: int, k: int, factor: float) -> DataFrame:
        """The best k of each query in each shard that it asks; a shard meets its queries in blocks."""
        reach = self.reach

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            schema = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            left, right = left.sort_by("place"), right.combine_chunks()
            rows, asked = ({c: t[c].combine_chunks() for c in t.column_names} for t in (left, right))
            last = np.iinfo(np.int64).max
            shard = Shard(_matrix(rows["v"]), np.asarray(rows["rid"]), np.asarray(rows["vec_id"].fill_null(last)), _matrix(rows["ranges"]), reach)
            scores, ids, found = shard.search(_matrix(asked["q"]), np.asarray(asked["own"]), np.asarray(asked["floor"]), k, factor)
            i, j = np.nonzero(found >= 0)
            whose = [asked[c].take(pa.array(i)) for c in ("number", "query_id")]
            return pa.table([*whose, pa.array(found[i, j]), pa.array(ids[i, j], mask=ids[i, j] == last), pa.array(scores[i, j])], schema=schema)

        keys = ["cell", "part", "block"]
        rows = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        return rows.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, every: int = 20, k: int = K, factor: float | None = None) -> DataFrame:
    """The k nearest rows found of each row whose vec_id is divisible by `every`."""
    index = Index(vectors)
    return index.search(index.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "rid"), k, factor)


def op12_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every vector whose vec_id is divisible by 20, by inner product."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
