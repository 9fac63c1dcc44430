"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere are removed.

Every window of SPAN bytes belongs to the leftmost smallest hash of its SEED-byte strings; consecutive windows
with the same one make a piece. Equal windows have equal seeds, so only pieces of seeds that occur twice can
repeat, and pieces meet by seed, as hashes. Equal pieces collapse to one with a count, those of one text before they
leave it; a seed whose pieces are all equal is settled by that count. The texts of the other seeds' distinct pieces
make collections. Of each the Burrows-Wheeler transform and the common prefixes are built column by column: a round
inserts one more symbol in front of every document, at the place that its tail's place and the symbol determine, and
merges the new rows into the sequences of the round before (transform, common prefixes, tails), which are read and
written from front to back. A symbol is eight bytes, and the eight phases of a piece are eight documents, so a common
prefix of 25 symbols is a repeat of 200 bytes. A seed of many distinct pieces is split: its windows meet by the bytes
that all windows of a like place around the seed have in common. The sequences of one collection, some 9 bytes a byte
of pieces, stay in the task's memory instead of files.

A null text is empty; texts shorter than SPAN keep all bytes. Repeated rows are occurrences of each other. Null ids are
kept. Other columns are ignored. An empty table gives no rows. The input must be repeatable, such as a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, flat, keyed, ragged, steps, written

SPAN = 200
SEED = 64
SYMBOL = 8
#: Windows that are cut at a time; a longer text is cut in several parts, which change no piece but those at the cuts.
PART = 1 << 20
#: Bits of a seed's hash that give way to its place in a part.
PLACE_BITS = 22
#: Bytes of pieces that one collection takes, if its seeds allow.
COLLECTION = 512 << 10
#: Distinct pieces of a seed from which on its windows are dealt by what else they have in common.
HOT_PIECES = 2000
#: Places around a hot seed that are dealt together.
PLACES = 16
#: Distinct pieces whose places may be broadcast, of some 40 bytes each; more are joined by a shuffle.
BROADCAST_PIECES = 1_000_000


def pieces(raw: np.ndarray, at: np.ndarray, roll: RollingHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, first window start, windows) of all pieces; a piece is n + SPAN - 1 bytes long."""
    none = np.zeros(0, np.int64)
    if len(raw) < SPAN:
        return none, none, none
    i = np.arange(len(raw) - SEED + 1)
    w = roll.slices(roll.prefix(raw), i, i + SEED)
    low = np.uint64((1 << PLACE_BITS) - 1)
    m, width = (w & ~low) | i.astype(np.uint64), 1
    span = SPAN - SEED + 1
    while 2 * width <= span:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    if span > width:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    place = (m & low).astype(np.int64)
    valid = np.zeros(len(m), bool)
    for a, b in zip(at[:-1], at[1:] - SPAN + 1):
        if b > a:
            valid[a:b] = True
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    starts = np.flatnonzero(first)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | first[1:]
    n = np.flatnonzero(ends) + 1 - starts
    # The order of seeds is that of their first bits; the rest was given to the place.
    return w[place[starts]].view(np.int64), starts, n


def _least(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of all ranges a .. b (inclusive) from a table of minima of 1, 2, 4, ... entries."""
    k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.uint8)
    for level in np.unique(k).tolist():
        pick = k == level
        out[pick] = np.minimum(levels[level][a[pick]], levels[level][b[pick] - (1 << level) + 1])
    return out


def repeats(collection: list[bytes]) -> list[np.ndarray]:
    """For each piece, which of its windows occur at another place of the collection."""
    docs, owner, phase = [], [], []
    for k, p in enumerate(collection):
        for f in range(min(SYMBOL, len(p) - SPAN + 1)):
            docs.append(np.frombuffer(p, ">u8", (len(p) - f) // SYMBOL, f))
            owner.append(k)
            phase.append(f)
    d = len(docs)
    length = np.array([len(x) for x in docs])
    symbols, ids = np.unique(np.concatenate(docs), return_inverse=True)
    ids = ids.astype(np.int32)
    begin = np.cumsum(length) - length
    full = SPAN // SYMBOL

    # Rows are suffixes in order, the d empty ones first. bwt: the symbol in front (-1: none); lcp: the common prefix with
    # the row before; tail: the row of the suffix without its first symbol. count: rows by first symbol.
    bwt, lcp, tail = ids[begin + length - 1], np.zeros(d, np.uint8), np.zeros(d, np.int32)
    count = np.zeros(len(symbols) + 1, np.int64)
    left = length - 1
    where, active = np.arange(d), np.arange(d)
    while len(active):
        n = len(bwt)
        src = where[active]
        order = np.argsort(bwt[src], kind="stable")  # active is in the order of its rows
        active, src = active[order], src[order]
        symbol = bwt[src]
        low = d + np.concatenate([[0], np.cumsum(count)])[symbol]
        ins, high = low.copy(), low + count[symbol]
        while (open_ := ins < high).any():  # the place among the rows of this symbol, by the tails
            mid = (ins + high) >> 1
            right = open_ & (tail[np.minimum(mid, n - 1)] < src)
            ins = np.where(right, mid + 1, ins)
            high = np.where(open_ & ~right, mid, high)
        fresh = ins + np.arange(len(ins))
        count += np.bincount(symbol, minlength=len(count))
        stop = d + np.cumsum(count)[symbol]
        start = stop - count[symbol]
        old = np.ones(n + len(ins), bool)
        old[fresh] = False

        def merged(before: np.ndarray, new: np.ndarray | int, old: np.ndarray = old, fresh: np.ndarray = fresh) -> np.ndarray:
            out = np.empty(len(old), before.dtype)
            out[old], out[fresh] = before, new
            return out

        tails = merged(tail, src)
        # Common prefixes of the new rows and of those right after them: 1 + the least between the tails.
        after = fresh[(fresh + 1 < stop)] + 1
        touch = np.concatenate([fresh[fresh > start], after[old[after]]])
        levels = [lcp]
        while (step := 1 << (len(levels) - 1)) * 2 <= n:
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        least = _least(levels, tails[touch - 1].astype(np.int64) + 1, tails[touch].astype(np.int64))
        lcp = merged(lcp, 0)
        lcp[touch] = np.minimum(least + 1, full)
        moved = (np.arange(n) + np.cumsum(np.bincount(ins, minlength=n + 1))[:n]).astype(np.int32)
        tail = moved[tails]
        left[active] -= 1
        bwt = merged(bwt, np.where(left[active] >= 0, ids[begin[active] + np.maximum(left[active], 0)], -1))
        where = moved[where].astype(np.int64)
        where[active] = fresh
        active = active[left[active] >= 0]
    hit = lcp >= full
    hit[:-1] |= hit[1:]
    out = [np.zeros(len(p) - SPAN + 1, bool) for p in collection]
    flat_out = np.zeros(sum(map(len, out)), bool)
    first = np.cumsum([0, *map(len, out)])
    owner, phase = np.array(owner), np.array(phase)
    windows = np.array(list(map(len, out)))[owner]
    row, doc = where, np.arange(d)
    for k in range(int(length.max())):  # from each whole document along the tails
        here = k * SYMBOL + phase[doc] < windows[doc]
        row, doc = row[here], doc[here]
        if not len(doc):
            break
        got = hit[row]
        flat_out[first[owner[doc[got]]] + k * SYMBOL + phase[doc[got]]] = True
        row = tail[row]
    return [flat_out[a:b] for a, b in zip(first, first[1:])]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _parts(at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte): whole rows, or a part of a long one, SPAN - 1 bytes over."""
    for lo, hi in steps(at, PART):
        a, b = int(at[lo]), int(at[hi])
        for x in range(a, max(a + 1, b - SPAN + 1), PART if hi == lo + 1 else max(1, b - a)):
            yield lo, hi, x, min(b, x + PART + SPAN - 1) if hi == lo + 1 else b


def _cut(rows: DataFrame) -> DataFrame:
    """d (a number), k1, k2 of every text, its pieces: v (seed), h (content), s (start), n (windows), c (how often in this
    text), each kind once; and own, the windows of those that repeat in the text."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, serial = RollingHash(), TaskContext.get().partitionId() << 40
        for b in batches:
            raw, at = flat(b[2])
            for lo, hi, x, y in _parts(at):
                rel = np.clip(at[lo : hi + 1] - x, 0, y - x)
                part = raw[x:y]
                v, s, n = pieces(part, rel, roll)
                h = roll.slices(roll.prefix(part), s, s + n + SPAN - 1).view(np.int64)
                doc = np.searchsorted(rel, s, "right") - 1
                order = np.lexsort((s, h, v, doc))
                new = np.ones(len(order), bool)
                same = (v[order][1:] == v[order][:-1]) & (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                new[1:] = ~same
                start = np.flatnonzero(new)
                c = np.diff(np.append(start, len(order)))
                again = np.repeat(c > 1, c)
                away = x - at[lo + doc]  # from places in the part to places in the text
                own_at = order[again]
                own_at = own_at[np.lexsort((s[own_at], doc[own_at]))]
                keep = order[start]
                of_doc = np.searchsorted(doc[keep], np.arange(hi - lo + 1)).astype(np.int32)
                own_of = np.searchsorted(doc[own_at], np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(of_doc), pa.array(z)) for z in (v[keep], h[keep], (s + away)[keep], n[keep], c)]
                places = pa.StructArray.from_arrays([pa.array((s + away)[own_at]), pa.array((s + away + n)[own_at])], ["a", "b"])
                own = pa.ListArray.from_arrays(pa.array(own_of), places).cast(span)
                yield pa.RecordBatch.from_arrays([pa.array(serial + np.arange(hi - lo)), b[0].slice(lo, hi - lo), b[1].slice(lo, hi - lo), *lists, own], ["d", "k1", "k2", "v", "h", "s", "n", "c", "own"])
                serial += hi - lo

    return rows.select("k1", "k2", "text").mapInArrow(run, "d long, k1 long, k2 long, v array<long>, h array<long>, s array<long>, n array<long>, c array<long>, own array<struct<a:long,b:long>>")


def _shared(body: np.ndarray, n: int, roll: RollingHash) -> Iterator[tuple[int, int, int]]:
    """(key, first window, end) of the parts of a hot piece: windows of PLACES neighbouring places around the seed, by the
    hash of the bytes that all windows of these places have."""
    i = np.arange(n - 1, SPAN - SEED + 1)
    prefix = roll.prefix(body)
    # Any place that depends on the windows' common bytes alone will do: that of the least hash in them.
    seed = int(i[np.argmin(roll.slices(prefix, i, i + SEED))])
    for low in range(seed - (SPAN - SEED), seed + 1, PLACES):
        first, end = max(0, low), min(n, low + PLACES)
        if first < end:
            a, b = low + PLACES - 1, low + SPAN
            a, b = max(a, 0), min(b, len(body))
            key = roll.slices(prefix, np.array([a]), np.array([b]))
            yield int(key.view(np.int64)[0]) ^ (low - seed), first, end


def _bodies(docs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """g (what meets), v, h, c, lo (first window), body of the distinct pieces."""
    few = reps.count() <= BROADCAST_PIECES
    of_doc = reps.join(docs.select("d", "k1", "k2"), reps["place.d"] == F.col("d")).groupBy("k1", "k2").agg(F.collect_list(F.struct("place.s", "place.n", "v", "h", "c", "hot")).alias("want"))
    of_doc = written(of_doc, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for b in batches:
            raw, at = flat(b[0])
            off = np.asarray(b[1].offsets).astype(np.int64)
            s, n, v, h, c, hot = (np.asarray(b[1].values.field(i)) if i < 5 else np.asarray(b[1].values.field(i).to_numpy(zero_copy_only=False)) for i in range(6))
            for lo, hi in steps(off, 4096):
                one = np.arange(off[lo], off[hi])
                start = at[np.repeat(np.arange(lo, hi), np.diff(off[lo : hi + 1]))] + s[one]
                first, windows, g, of = np.zeros(len(one), np.int64), n[one], v[one], one
                if hot[one].any():
                    parts = [(g[k], 0, windows[k], i) for k, i in enumerate(one.tolist()) if not hot[i]]
                    for k, i in enumerate(one.tolist()):
                        if hot[i]:
                            parts += [(key, x, y - x, i) for key, x, y in _shared(raw[start[k] : start[k] + n[i] + SPAN - 1], int(n[i]), roll)]
                    g, first, windows, of = (np.array([p[j] for p in parts], np.int64) for j in range(4))
                    start = start[of - off[lo]]
                size = windows + SPAN - 1
                cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(ragged(raw, start + first, size))])
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(v[of]), pa.array(h[of]), pa.array(c[of]), pa.array(first), data], ["g", "v", "h", "c", "lo", "body"])

    found = texts.join(F.broadcast(of_doc) if few else of_doc, ["k1", "k2"])
    return found.select("text", "want").mapInArrow(run, "g long, v long, h long, c long, lo long, body binary")


def _marks(bodies: DataFrame, parts: int) -> DataFrame:
    """v, h, marks: the windows of distinct pieces that other pieces have too."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def close() -> pa.RecordBatch:
            out = []
            for (_, v, h, c, lo, _), mask in zip(held, repeats([x[5] for x in held]) if len(held) > 1 else [np.zeros(1, bool)] * len(held)):
                a, b = _runs(mask)
                if len(a) and c < 2:
                    out.append((v, h, [{"a": int(x) + lo, "b": int(y) + lo} for x, y in zip(a, b)]))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), span))], ["v", "h", "marks"])

        for b in batches:
            for row in zip(*(col.to_pylist() for col in b.columns)):
                if last and (row[0], row[1], row[2], row[4]) == last:  # the text of an equal row
                    continue
                if size >= COLLECTION and row[0] != last[0]:
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = (row[0], row[1], row[2], row[4])
        yield close()

    dealt = bodies.repartition(parts, "g").sortWithinPartitions("g", "v", "h", "lo")
    return dealt.mapInArrow(collections, "v long, h long, marks array<struct<a:bigint,b:bigint>>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, spans): for every text with repeats, array<struct<a, b>> of window starts that repeat."""
    rows = keyed(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(_cut(rows), "cut")
    every = cut.select("d", F.explode(F.arrays_zip("v", "h", "s", "n", "c")).alias("x")).select("d", "x.*")
    twice = every.groupBy("v").agg(F.sum("c").alias("all"), (F.min("h") != F.max("h")).alias("multi")).where("all > 1").select("v", "multi")
    held = written(every.join(twice, "v"), "pieces")
    several = held.where("multi")
    reps = several.groupBy("v", "h").agg(F.min(F.struct("d", "s", "n")).alias("place"), F.sum("c").alias("c"))
    reps = written(reps, "distinct")
    hot = reps.groupBy("v").agg(F.count("*").alias("k")).where(F.col("k") > HOT_PIECES).select("v", F.lit(True).alias("hot"))
    reps = reps.join(hot, "v", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    marks = _marks(_bodies(cut, reps, rows), parts)
    some = several.join(marks, ["v", "h"]).select("d", F.explode(F.transform("marks", lambda m: F.struct((m["a"] + F.col("s")).alias("a"), (m["b"] + F.col("s")).alias("b")))).alias("x"))
    whole = several.join(reps.where("c > 1").select("v", "h"), ["v", "h"], "left_semi").unionByName(held.where("not multi"))
    spots = some.unionByName(whole.select("d", F.struct(F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b")).alias("x")))
    found = spots.groupBy("d").agg(F.collect_list("x").alias("found"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    spans = cut.select("d", "k1", "k2", "own").join(found, "d", "left").where("found is not null or size(own) > 0").select("k1", "k2", F.sort_array(F.concat("own", F.coalesce("found", none))).alias("x"))
    # Equal rows have equal repeats; a long text has several rows of pieces.
    return spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("x")).alias("spans"))


def dedup_bytes(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row."""
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(repeated_spans(docs), ["k1", "k2"], "left").select("doc_id", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = flat(b[1])
            out = []
            for i in range(b.num_rows):
                own, x, y = raw[at[i] : at[i + 1]], b[2][i], b[3][i]
                gone = np.zeros(len(own), bool)
                if x.is_valid:
                    depth = np.zeros(len(own) + 1, np.int32)
                    np.add.at(depth, np.asarray(x.values), 1)
                    np.subtract.at(depth, np.asarray(y.values) + SPAN - 1, 1)
                    gone = np.cumsum(depth)[:-1] > 0
                kept = own[~gone].tobytes() if x.is_valid else own.tobytes()
                out.append((len(own), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([b[0], *cols[: 4 + with_text]], ["doc_id", *names[: 4 + with_text]])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; see the module's head for odd rows."""
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
