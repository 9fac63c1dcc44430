"""Benchmark decontamination with DataFrame expressions alone.

Benchmark texts become windows of 8 normalised words (a shorter item is one window); documents' token windows
are scanned against a broadcast hash set of them, whose size is checked first (beyond the bound the same join
is a shuffled one); hits are verified on the words; documents or spans are removed. Texts without words, null
texts and empty tables have no windows. Rows with equal id and text get equal results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, written

WINDOW = 8
MIN_ITEMS = 2
#: Windows that may be broadcast: 8 bytes of hash, an id and a length each, some 100 MB.
BROADCAST_WINDOWS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


_APART = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: Column) -> Column:
    """WORD matches of the text in lower case: all other ASCII becomes blanks, at which the text is split."""
    plain = F.trim(F.translate(text, _UPPER + _APART, _LOWER + " " * len(_APART)))
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def _hash(word, n: int) -> Column:
    """The hash of a window, from word(k), the hash of its k-th word."""
    return F.xxhash64(*(word(k) for k in range(n)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, words, items, hash): each distinct window once, with the ids of its items."""
    rows = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))
    each = rows.select("item_id", F.explode(cut).alias("words")).groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("len", F.size("words"))
    of = lambda n: _hash(lambda k: F.xxhash64(F.get("words", F.lit(k))), n)
    case = F.lit(None).cast("bigint")
    for k in range(1, window + 1):
        case = F.when(F.col("len") == k, of(k)).otherwise(case)
    return each.withColumn("hash", case)


def _bits(hashes: list[int]) -> Column:
    """Column -> Column factory: whether a hash may be one of hashes; a bit map of at least 64 bits for each."""
    size = 1 << max(16, (64 * len(hashes)).bit_length())
    longs = [0] * (size // 64)
    for h in hashes:
        longs[(h & (size - 1)) >> 6] |= 1 << (h & 63)
    table = F.from_json(F.lit(json.dumps([x - (1 << 64) if x >> 63 else x for x in longs])), "array<bigint>")
    return lambda h: F.getbit(F.get(table, F.shiftright(h.bitwiseAND(F.lit(size - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1, k2 (of keyed()), doc_id, copies (equal rows), n_words, spans and items of every text: distinct
    array<struct<pos, len>>, pos from 0, and distinct item ids; both are empty without hits.

    One narrow scan hashes every window of words; what is in no benchmark text ends there, by a bit map of the
    benchmark's hashes; the rest is joined with the benchmark's windows and verified on the words. A row of
    length 0 carries the number of words; it meets no window, and its hash is the text's own, which spreads the rows.
    """
    windows = written(benchmark_windows(benchmark, window), "windows")
    total = windows.count()
    small = total <= BROADCAST_WINDOWS
    known = windows.select("len", "hash").collect() if small else []  # at most BROADCAST_WINDOWS rows
    lengths = [r["len"] for r in windows.select("len").distinct().orderBy("len").collect()]  # at most `window` rows
    base = keyed(docs).select("k1", "k2", "doc_id", words(F.col("text")).alias("w"))
    hashed = base.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))

    def placed(n: int) -> Column:
        at = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
        if small:
            may = _bits([r["hash"] for r in known if r["len"] == n])
            at = F.filter(at, lambda i: may(_hash(lambda k: F.get("h", i + k), n)))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), _hash(lambda k: F.get("h", i + k), n).alias("hash"), F.slice("w", i + 1, F.lit(n)).alias("words")))

    whole = F.array(F.struct(F.size("w").alias("pos"), F.lit(0).alias("len"), F.xxhash64("k1", "k2").alias("hash"), F.array().cast("array<string>").alias("words")))
    scan = hashed.select("k1", "k2", "doc_id", F.explode(F.concat(whole, *map(placed, lengths))).alias("x")).select("k1", "k2", "doc_id", "x.*")
    side = windows.select("hash", F.col("len").alias("len_"), F.col("words").alias("words_"), "items")
    side = F.broadcast(side) if small else side.withColumnRenamed("hash", "hash_")
    met = scan.join(side, "hash", "left") if small else scan.join(side, (F.col("hash") == F.col("hash_")) & (F.col("len") > 0), "left")
    found = met.where("len = 0 or (len = len_ and words = words_)")
    head = F.col("len") == 0
    span = F.when(~head, F.struct("pos", "len"))
    per_text = found.groupBy("k1", "k2", "doc_id").agg(
        F.count_if(head).alias("copies"), F.max(F.when(head, F.col("pos"))).cast("bigint").alias("n_words"),
        F.collect_set(span).alias("spans"), F.collect_set(F.when(~head, F.col("items"))).alias("items"),
    )
    return per_text.withColumn("items", F.array_distinct(F.flatten("items")))


def _covered(spans: Column) -> Column:
    """Number of words inside any span: the union of the intervals, from left to right."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    ends = F.array_sort(F.transform(spans, lambda x: F.struct(x["pos"].alias("a"), (x["pos"] + x["len"]).alias("b"))))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).cast("bigint").alias("n"))
    return F.aggregate(ends, start, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    each = find_hits(docs, benchmark).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n = F.size("items").cast("bigint")
    return each.select("doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), n.alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the text without the hit words and the separators after them."""
    first = F.when(F.substring("text", 1, 1).rlike(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(1)).otherwise(F.lit(0))
    pieces = F.regexp_extract_all("text", F.lit(_PIECES), 0)
    rows = keyed(docs).join(find_hits(docs, benchmark).where(F.size("spans") > 0).drop("doc_id"), ["k1", "k2"], "left").withColumns({"pieces": pieces, "skip": first})
    number = lambda i: F.floor((i - F.col("skip")) / 2)
    keep = F.filter("pieces", lambda p, i: ~F.exists("spans", lambda x: (x["pos"] <= number(i)) & (number(i) < x["pos"] + x["len"])))
    return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(keep, "")).alias("text"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """The rows of docs, all columns, whose text holds windows of fewer than min_items items. Null ids are kept apart by the text."""
    bad = find_hits(docs, benchmark).where(F.size("items") >= min_items).select(F.struct("k1", "k2").alias("bad"))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.xxhash64(docs["doc_id"], text).alias("k1"), F.xxhash64(text, docs["doc_id"], F.lit("k2")).alias("k2"))
    return docs.join(bad, key == bad["bad"], "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated of every document; null texts have no words, null ids are kept."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_W = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"
OP6_SQL = f"""
WITH i AS (SELECT item_id, {_W} AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, w[k:k + least(8, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM b),
d AS (SELECT doc_id, {_W} AS w FROM documents),
t AS (SELECT doc_id, k, n, w[k:k + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
h AS (SELECT t.doc_id, t.k, t.n, b.item_id FROM t JOIN b ON t.g = b.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
