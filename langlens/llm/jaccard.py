"""N-gram Jaccard join of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

near_duplicates gives the classes that the links make, for which it need not ask for links within a class;
similar_pairs and link_counts give all links, by steps 1 and 3 without classes.

Sets are 64-bit hashes of shingles. Equal sets collapse first. Then, exactly:
1. Length-bounded prefixes in hash order: similar sets share at least l of the first |x| - ceil(0.8 |x|) + l hashes,
   so a set with fewer prefix hashes that occur in any other set's prefix has no partner and leaves. A hash that
   many sets of a task share is settled there and leaves it as one entry.
2. Answer-level skipping: sets meet under their smallest hash by three orders, those with most shared hashes first.
   A set that is similar to none before it becomes a leader, whose overlaps with the other leaders are kept. A set
   that is similar to a leader derives its overlap with each other leader from that leader's overlap and the few
   hashes in which the two differ, and skips the leaders that are out of reach by the number of those alone.
3. Index-level skipping: inverted lists of the prefixes, rarest hashes first, sorted by size and position, in blocks
   that know the most that can follow in any of their sets. Pairs of blocks are skipped whole by size, by position
   (what can still follow is too little) and where all share a class; then entries by the same bounds. The remaining
   candidate pairs are verified on the sets.
4. Classes are the connected components of the verified links, by smallest labels in an order drawn anew each round.

Null, blank and empty texts have empty sets and link with nothing. Repeated rows have equal sets. Rows with a null id
take part, but don't name a component. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, lower, quoted, slice_hashes, steps, trim, word_grams, words, written

WORDS = 5
#: Similarity as a fraction, compared in whole numbers: UP * intersection >= OF * union.
UP, OF = 100, 80
ORDERS = 3
#: Sets with a possible partner whose rows' keys (16 bytes) may be broadcast; more are joined by a shuffle.
BROADCAST_SETS = 500_000
#: Prefix hashes that a task holds before it sends them on.
HELD = 1 << 20
#: Buckets of hashes, each sorted by one task at a time.
BUCKETS = 4096


def shingles(raw: np.ndarray, at: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Of each row the sorted distinct hashes of its n-word shingles; with fewer words, of all its words as one."""
    start, end, by_doc = words(raw, at)
    token = slice_hashes(raw, start, end)
    out = []
    count = np.diff(by_doc)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = ragged_arange(by_doc[:-1], size)
    stop = np.minimum(first + n, np.repeat(by_doc[1:], size))
    hashes = word_grams(token, first, stop, n)
    cut = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(cut, cut[1:]):
        out.append(np.unique(hashes[a:b]))
    return out


def ragged_arange(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)


def least(n: np.ndarray | int):
    """The smallest intersection that a set of n needs: ceil(0.8 n)."""
    return -(-(OF * n) // UP)


def extra(n):
    """l of step 1 for a set of n; it never falls as n grows."""
    return n // 20 + 1


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return UP * both >= OF * (len(x) + len(y) - both)


def _sets(batch: pa.RecordBatch, col: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    raw, at = flat(batch[col])
    for lo, hi in steps(at):
        yield lo, shingles(lower(raw[at[lo] : at[hi]]), at[lo : hi + 1] - at[lo])


def _signature(x: np.ndarray) -> int | None:
    """64 bits that stand for a set; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) if len(x) else None


def _list(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([v.view(np.int64) for v in values]) if values else np.zeros(0, np.int64)))


def _prefix(x: np.ndarray) -> np.ndarray:
    return x[: len(x) - least(len(x)) + extra(len(x))]


def _marked(rows: DataFrame) -> DataFrame:
    """k1, k2 (128 bits of id and text), doc_id, n, sid and the prefix of step 1 of every row: the one scan of all texts."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in _sets(b, 3):
                own = [b[i].slice(lo, len(part)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) for x in part], pa.int64()), pa.array([_signature(x) for x in part], pa.int64()), _list([_prefix(x) for x in part])], ["k1", "k2", "doc_id", "n", "sid", "items"])
        trim()

    return _row_keys(rows).select("k1", "k2", "doc_id", "text").mapInArrow(run, f"k1 long, k2 long, doc_id {kind}, n long, sid long, items array<long>")


def _row_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id", F.lit("k2"))})


def _credit(h: np.ndarray, sid: np.ndarray, n: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of entries (hash, set, its size, whether it stands for several sets that know of each other): the sets with
    hashes that another set has too and how many, as (sid, n, hits); and one entry for each hash."""
    order = np.lexsort((sid, h))
    h, sid, n, many = h[order], sid[order], n[order], many[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
    first = np.flatnonzero(new)
    # Several entries of one set and hash: one, that stands for several if any does.
    many = np.logical_or.reduceat(many, first) if len(first) else many
    h, sid, n = h[first], sid[first], n[first]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(h)))
    shared = (size > 1) | (np.logical_or.reduceat(many, start) if len(start) else head)
    gets = np.repeat(shared, size) & ~many
    who, at, hits = np.unique(sid[gets], return_index=True, return_counts=True)
    return who, n[gets][at], hits, h[start], sid[start], n[start], shared


def survivors(marked: DataFrame) -> DataFrame:
    """sid, hits of the distinct sets that pass step 1."""
    spark = marked.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            h, sid, n = (np.concatenate(x) for x in held)
            who, n_who, hits, h, sid, n, many = _credit(h, sid, n, np.zeros(len(h), bool))
            bucket = (h.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
            blobs = [np.stack([h[p], sid[p], n[p] * 2 + many[p]]).tobytes() for p in (order[a:b] for a, b in zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "data"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([np.stack([who, n_who, hits]).tobytes()], pa.binary())], ["bucket", "data"])

        for b in batches:
            items = b[2]
            sizes = np.asarray(items.value_lengths()).astype(np.int64)
            keep = np.asarray(b[0].is_valid())
            held[0].append(np.asarray(items.flatten()))
            held[1].append(np.repeat(np.where(keep, np.asarray(b[0].fill_null(0)), 0), sizes))
            held[2].append(np.repeat(np.asarray(b[1]), sizes))
            size += int(sizes.sum())
            if size >= HELD:
                yield from close()
                held, size = [[], [], []], 0
        if size:
            yield from close()
        held = []
        trim()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[bytes]] = {}
        for b in batches:
            for k, data in zip(b[0].to_pylist(), b[1].to_pylist()):
                mine.setdefault(k, []).append(data)
        for k in list(mine):
            cols = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in mine.pop(k)], 1)
            who, n, hits = cols if k < 0 else _credit(cols[0], cols[1], cols[2] >> 1, (cols[2] & 1).astype(bool))[:3]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n), pa.array(hits)], ["sid", "n", "hits"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.select("sid", "n", "items").mapInArrow(gather, "bucket long, data binary")
    # What a task has settled itself carries the bucket -1 and is dealt by its place.
    spread = dealt.repartition(parts, F.when(F.col("bucket") < 0, F.xxhash64("data")).otherwise(F.col("bucket")))
    need = F.expr(f"(({OF} * n + {UP - 1}) div {UP}) div 20 + 1")
    found = spread.mapInArrow(settle, "sid long, n long, hits long").groupBy("sid", "n").agg(F.sum("hits").alias("hits"))
    return found.where(F.col("hits") >= need).select("sid", "hits")


def distinct_sets(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """sid, n, items, hits of the distinct sets that pass step 1, from the text of one row of each."""
    passed = written(survivors(marked), "passed")
    one = marked.select("sid", "k1", "k2").join(passed, "sid").groupBy("sid").agg(F.min("k1").alias("k1"), F.first("hits").alias("hits"))
    # A row with the least k1 of its set has a text of that set; several such rows have equal sets.
    keys = written(one.select("k1", "hits"), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_SETS else keys
    texts = _row_keys(rows).join(keys, "k1").select("text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in _sets(b, 0):
                yield pa.RecordBatch.from_arrays([pa.array([_signature(x) for x in part], pa.int64()), pa.array([len(x) for x in part], pa.int64()), _list(part), b[1].slice(lo, len(part))], ["sid", "n", "items", "hits"])
        trim()

    return written(texts.mapInArrow(run, "sid long, n long, items array<long>, hits long").dropDuplicates(["sid"]), "sets")


#: Leaders of one key that a task holds at a time.
LEADERS = 64


def leader_links(sets: DataFrame) -> DataFrame:
    """(a, b): sets with a leader that they are similar to, verified.

    Two rounds: hot keys are salted in the first; sets that follow no leader, the leaders among them, meet unsalted
    in the second. A task holds LEADERS sets at a time; what stays unlinked here is left to the prefix lists.
    """
    first = written(_leader_round(sets, 8), "leaders")
    rest = sets.join(first.select(F.col("a").alias("sid")).distinct(), "sid", "left_anti")
    return first.unionByName(_leader_round(rest, 1))


class Leaders:
    """The leaders of one key, and their overlaps with each other: the answers that similar sets start from."""

    def __init__(self) -> None:
        self.sids: list[int] = []
        self.items: list[np.ndarray] = []
        self.sizes = np.zeros(LEADERS, np.int64)
        self.overlap = np.zeros((LEADERS, LEADERS), np.int64)

    def meet(self, sid: int, x: np.ndarray) -> list[int]:
        """The leaders that x is similar to; x becomes a leader if there are none."""
        k = len(self.sids)
        both = np.zeros(k, np.int64)
        for i, lead in enumerate(self.items):
            if UP * min(len(x), len(lead)) < OF * max(len(x), len(lead)) and k >= LEADERS:
                continue
            both[i] = _overlap(x, lead)
            if UP * both[i] >= OF * (len(x) + len(lead) - both[i]):
                return [self.sids[j] for j in self._derived(i, x, both)]
        if k < LEADERS:
            self.sids.append(sid)
            self.items.append(x.copy())
            self.sizes[k] = len(x)
            self.overlap[k, :k] = self.overlap[:k, k] = both
            self.overlap[k, k] = len(x)
        return []

    def _derived(self, i: int, x: np.ndarray, both: np.ndarray) -> list[int]:
        """Leaders similar to x, given that leader i is: only the hashes in which x and i differ are looked up."""
        lead, k = self.items[i], len(self.sids)
        more, fewer = x[~_has(lead, x)], lead[~_has(x, lead)]
        most = np.minimum(self.overlap[i, :k] + len(more), np.minimum(len(x), self.sizes[:k]))
        may = UP * most >= OF * (len(x) + self.sizes[:k] - most)
        out = [i]
        for j in np.flatnonzero(may).tolist():
            if j <= i:  # compared before, and not similar
                continue
            o = int(self.overlap[i, j]) + int(_has(self.items[j], more).sum()) - int(_has(self.items[j], fewer).sum())
            if UP * o >= OF * (len(x) + int(self.sizes[j]) - o):
                out.append(j)
        return out


def _has(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of y are in x, both sorted."""
    if not len(x):
        return np.zeros(len(y), bool)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return x[at] == y


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    return int(_has(x, y).sum()) if len(x) > len(y) else int(_has(y, x).sum())


def _leader_round(sets: DataFrame, salts: int) -> DataFrame:
    def least_hash(o: int) -> Column:
        return F.array_min(F.transform("items", lambda h: F.xxhash64(h, F.lit(o))))

    keys = F.array(*map(least_hash, range(ORDERS)))
    spread = sets.select("sid", "n", "items", "hits", F.posexplode(keys).alias("o", "key")).withColumn("salt", F.pmod("sid", F.lit(salts)))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, leads = None, Leaders()
        for b in batches:
            raw, at = b[1].flatten(), np.asarray(b[1].offsets) - b[1].offsets[0].as_py()
            items = np.asarray(raw).view(np.uint64)
            out = []
            for i, (sid, *group) in enumerate(zip(*(b[k].to_pylist() for k in (0, 2, 3, 4)))):
                if group != head:
                    head, leads = group, Leaders()
                out += [(sid, lead) for lead in leads.meet(sid, items[at[i] : at[i + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = spread.withColumn("lone", 1 - F.col("hits") / F.col("n")).repartition(parts, "o", "key", "salt").sortWithinPartitions("o", "key", "salt", "lone", "sid")
    return dealt.select("sid", "items", "o", "key", "salt").mapInArrow(run, "a long, b long").distinct()


#: Entries of a block of an inverted list.
BLOCK = 64


def list_pairs(n: np.ndarray, sid: np.ndarray, pos: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one list, sorted by n and pos: blocks are skipped first, then entries."""
    rest = n - pos  # hashes from this one on: as many as a set can still share
    start = np.arange(0, len(n), BLOCK)
    most, low, high = np.maximum.reduceat(rest, start), n[start], n[np.minimum(start + BLOCK, len(n)) - 1]
    lone = np.where(np.minimum.reduceat(root, start) == np.maximum.reduceat(root, start), root[start], -1)
    for i in range(len(start)):
        need = -(-(OF * (low[i] + low[: i + 1])) // (UP + OF))
        ok = (UP * high[: i + 1] >= OF * low[i]) & (np.minimum(most[i], most[: i + 1]) >= need)
        if lone[i] != -1:
            ok &= lone[: i + 1] != lone[i]
        a = np.arange(start[i], min(start[i] + BLOCK, len(n)))
        a = a[rest[a] >= least(n[a])]
        for j in np.flatnonzero(ok).tolist():
            b = np.arange(start[j], min(start[j] + BLOCK, len(n)))
            b = b[rest[b] >= -(-(OF * (n[b] + low[i])) // (UP + OF))] if j < i else b
            if not len(a) or not len(b):
                continue
            x, y = a[:, None], b[None, :]
            want = -(-(OF * (n[x] + n[y])) // (UP + OF))
            good = (x > y) & (root[x] != root[y]) & (UP * n[y] >= OF * n[x]) & (np.minimum(rest[x], rest[y]) >= want)
            p, q = np.nonzero(good)
            if len(p):
                p, q = sid[a[p]], sid[b[q]]
                yield np.minimum(p, q), np.maximum(p, q)


def candidate_pairs(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of different classes that length, position and rarest-first prefixes leave."""
    spread = sets.select("sid", "n", F.explode("items").alias("h"))
    df = spread.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    kept = spread.join(df, "h").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("t"))
    lone = F.col("n") - F.size("t")  # hashes of this set alone come first in the order
    prefix = F.expr(f"n - (({OF} * n + {UP - 1}) div {UP}) + 1")
    lists = kept.withColumns({"lone": lone, "take": F.least(F.size("t"), F.greatest(F.lit(0), prefix - lone)).cast("int")}).where("take > 0")
    lists = lists.join(classes, "sid", "left").select("sid", "n", "lone", F.coalesce("root", "sid").alias("root"), F.posexplode(F.slice("t", F.lit(1), F.col("take"))).alias("i", "x"))
    lists = written(lists.select(F.col("x.h").alias("h"), "n", "sid", (F.col("lone") + F.col("i")).alias("pos"), "root"), "lists")
    mixed = lists.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                for a, b in list_pairs(*(np.concatenate([x[k] for x in held]) for k in range(1, 5))):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            cuts = [0, *(np.flatnonzero(np.diff(cols[0])) + 1), len(cols[0])]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if cols[0][lo] != head:
                    yield from close()
                    head, held = cols[0][lo], []
                held.append([c[lo:hi] for c in cols])
        yield from close()

    dealt = lists.join(mixed, "h", "left_semi").repartition(parts, "h").sortWithinPartitions("h", "n", "pos", "sid")
    return dealt.select("h", "n", "sid", F.col("pos").cast("long").alias("pos"), "root").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("sid").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(UP * both >= OF * (F.size("x") + F.size("y") - both)).select("a", "b")


def components(links: DataFrame, limit: int = 200) -> DataFrame:
    """(sid, root) of every linked node. Each round points nodes at their least neighbour, by an order of the labels that
    is drawn anew (so that chains of any labels fall by a share a round), and contracts the links."""
    spark = links.sparkSession
    edges = written(links.where("a <> b").select("a", "b"), "links")
    labels = spark.createDataFrame([], "sid long, root long")
    draw = random.Random(20240607)
    for turn in range(limit):
        if edges.isEmpty():
            return labels
        key = F.lit(draw.getrandbits(63) - (1 << 62))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(key)).alias("m")).select(F.col("a").alias("node"), F.least(F.col("a").bitwiseXOR(key), "m").bitwiseXOR(key).alias("to"))
        step = written(step, "step")
        if turn:
            moved = labels.join(step, F.col("root") == F.col("node"), "left").select("sid", F.coalesce("to", "root").alias("root"))
            labels = written(moved, "labels")
        else:
            labels = step.select(F.col("node").alias("sid"), F.col("to").alias("root"))
        s2 = step.select(F.col("node").alias("node2"), F.col("to").alias("to2"))
        edges = written(edges.join(step, F.col("a") == F.col("node")).join(s2, F.col("b") == F.col("node2")).select(F.col("to").alias("a"), F.col("to2").alias("b")).where("a <> b").distinct(), "links")
    raise RuntimeError("components did not settle")


def _classed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The marked rows, and (sid, root) of the sets that link with any."""
    marked = written(_marked(rows), "marked")
    sets = distinct_sets(rows, marked)
    near = written(leader_links(sets), "leaders")
    links = near.unionByName(verified(written(candidate_pairs(sets, components(near)), "pairs"), sets))
    return marked, components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row. Null ids don't name a component; one of nulls alone has none."""
    marked, roots = _classed(documents(docs, id_col, text_col))
    named = marked.select("doc_id", "n", "sid").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    names = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(names, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), a < b, of distinct sets that are similar, also within a class; and (doc_id, n, sid), the rows
    of each set. Rows of one set are similar too, but for the empty one, which has no sid."""
    rows = documents(docs, id_col, text_col)
    members = written(_marked(rows), "marked")
    sets = distinct_sets(rows, members)
    no_classes = docs.sparkSession.createDataFrame([], "sid long, root long")
    return verified(written(candidate_pairs(sets, no_classes), "pairs"), sets), members.select("doc_id", "n", "sid")


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_links of every row: the number of other rows that it is similar to."""
    pairs, members = similar_pairs(docs)
    pairs = written(pairs, "links")
    copies = members.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.withColumnRenamed("sid", "b"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("copies").alias("others"))
    counts = copies.join(others, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counts, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, less the rows of a component that aren't its least by (id, hash of id and text), null
    ids last. Equal rows count as copies: one of them stays. Rows with empty sets stay.

    Rows are told apart by a 128-bit hash of id and text; ids needn't be unique."""
    own = ["__row", "__k1", "__k2"]
    packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("__row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("__k1"), F.xxhash64(F.coalesce("text", F.lit("")), "doc_id", F.lit("k2")).alias("__k2"))
    marked, roots = _classed(documents(docs))
    named = marked.where("sid is not null").join(roots, "sid", "left").select("k1", "k2", F.coalesce("root", "sid").alias("root"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("place"))
    lead = named.groupBy("root").agg(F.min("place").alias("lead"))
    gone = named.join(lead, "root").where("place <> lead").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    kept = packed.join(written(gone, "gone"), ["__k1", "__k2"], "left_anti")
    # Of equal rows of one key with words, one stays: they are copies of each other.
    twins = written(named.groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), "twins")
    lone = kept.join(twins, ["__k1", "__k2"], "left_anti")
    one = kept.join(twins, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return lone.select(*own[:1]).unionByName(one.select(*own[:1])).select("__row.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; see near_duplicates for odd rows."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
