"""Line dedup with DataFrame expressions alone: a deletion-neighbourhood join.

A line goes if an earlier line equals it or is within one edit of it. Lines of every length are compared as they
stand in the input; earlier means (doc_id, a hash of id and text, line number), null ids first; blank lines stay.
Rows with equal id and text count as one document. A null text is the empty text.

Only the first of equal lines goes on, as hashes: what stays of a document is the set of its lines that are the
first of their kind, so that a line of any frequency is one row. Of two lines within one edit, the shorter of m
characters, one half of m is the same in both. Lines of which a half meets another line's emit the deletion
neighbourhood of the other half: every variant with one character deleted, hashed with the half that they share.
Half-lines are cut into blocks, so that a line of n characters costs n ** 1.5 at most. Equal variants join: with
the place for replaced characters, against the whole for inserted ones; the earliest of each side settles a key
without forming pairs. A key holds no copies, only the different lines within one edit of one text, so its size is
bounded by the characters there are and the text's length. The edit distance to that earlier line is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, quoted, written

#: Characters of a half-line that are varied together, at least.
BLOCK = 256
#: Lines whose places may be broadcast, of some 100 bytes each; more are joined by a shuffle.
BROADCAST_LINES = 200_000
#: Characters that one task varies, about: each gives a variant.
VARIED = 500_000
_KINDS = [(less, half) for less in (0, 1) for half in (0, 1)]
_BLANK = r"^[\t-\r ]*$"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, no, line: every line that isn't blank."""
    rows = keyed(docs).select("doc_id", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.where(~F.col("line").rlike(_BLANK))


def _half(n: Column, less: int, half: int) -> tuple[Column, Column, Column, Column]:
    """m, its first position of the half that varies (from 0), characters of that half in m, and in the line."""
    m = n - less
    cut = F.floor(m / 2).cast("int")
    a, size = (F.lit(0), cut) if half == 0 else (cut, m - cut)
    return m, a, size, size + less


def _meeting_keys(line: Column, n: Column) -> Column:
    """array<long>: by kind, the hash of the half that stays the same; null where there is none."""
    out = []
    for less, half in _KINDS:
        m, a, size, own = _half(n, less, half)
        same = F.substring(line, own + 1, n) if half == 0 else F.substring(line, F.lit(1), a)
        out.append(F.when(m > 0, F.xxhash64(F.lit(half), m, same)))
    return F.array(*out)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h, h2 (128 bits that stand for a line), first (doc_id, k1, k2, no), keys: a row for each distinct line."""
    lines = _lines(docs).withColumn("n", F.length("line"))
    each = lines.select(F.xxhash64("line", "n").alias("h"), F.xxhash64(F.lit("h2"), "line").alias("h2"), F.struct("doc_id", "k1", "k2", "no").alias("ord"), _meeting_keys(F.col("line"), F.col("n")).alias("keys"))
    return each.groupBy("h", "h2").agg(F.min("ord").alias("first"), F.first("keys").alias("keys"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, with the text of each line; joined by document, which a row of documents is part of once."""
    of_doc = wanted.groupBy("first.k1", "first.k2").agg(F.collect_list(F.struct("h", "h2", "first", "kinds")).alias("want"))
    few = wanted.count() <= BROADCAST_LINES
    rows = keyed(docs).join(F.broadcast(of_doc) if few else of_doc, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    cut = rows.select(F.split("text", "\n").alias("l"), F.explode("want").alias("x"))
    return cut.select("x.*", F.get("l", F.col("x.first.no")).alias("line"))


def _blocks(near: DataFrame) -> DataFrame:
    """first, less and for each block of a varied half: at, g and g2 (hashes of all else), mid."""
    n = F.length("line")
    rows = near.select("first", "line", n.alias("n"), F.explode("kinds").alias("kind"))
    less, half = F.floor(F.col("kind") / 2).cast("int"), F.col("kind") % 2
    rows = rows.withColumns({"m": F.col("n") - less, "less": less})
    cut = F.floor(F.col("m") / 2).cast("int")
    rows = rows.withColumns({"a": F.when(half == 0, F.lit(0)).otherwise(cut), "size": F.when(half == 0, cut).otherwise(F.col("m") - cut)})
    rows = rows.withColumn("width", F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("size")).cast("int")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / F.col("width")).cast("int")))).alias("b"))
    rows = rows.withColumns({"at": F.col("a") + F.col("b") * F.col("width"), "end": F.col("a") + F.least(F.col("size"), (F.col("b") + 1) * F.col("width"))})
    around = [F.col("m"), F.col("at"), F.substring("line", F.lit(1), F.col("at")), F.substring("line", F.col("end") + F.col("less") + 1, F.col("n"))]
    mid = F.substring("line", F.col("at") + 1, F.col("end") - F.col("at") + F.col("less"))
    return rows.select("first", "less", "at", F.xxhash64(*around).alias("g"), F.xxhash64(F.lit("g2"), *around).alias("g2"), mid.alias("mid"))


def _variants(mid: Column, less: Column, at: Column, g: Column, g2: Column) -> Column:
    """array<struct<v, v2, role, place>>: 0 a character deleted, with its place; 1 the whole; 2 a longer one with a character
    deleted. place: of that character in the line, from 0."""
    size = F.length(mid)
    some = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    without = F.transform(some, lambda i: F.struct(i.alias("i"), F.concat(F.substring(mid, F.lit(1), i - 1), F.substring(mid, i + 1, size)).alias("t")))
    made = lambda role, i, *parts: F.struct(F.xxhash64(g, *parts).alias("v"), F.xxhash64(g2, *parts).alias("v2"), F.lit(role).alias("role"), (at + i - 1).alias("place"))
    same = F.transform(without, lambda x: made(0, x["i"], F.lit("replace"), x["i"], x["t"]))
    whole = F.array(made(1, F.lit(1), F.lit("insert"), mid))
    longer = F.transform(without, lambda x: made(2, x["i"], F.lit("insert"), x["t"]))
    return F.when(less == 0, F.concat(same, whole)).otherwise(longer)


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h, h2, near_to): distinct lines with an earlier line within one edit; near_to is that line's place."""
    keys = distinct.select("h", F.explode("keys").alias("key")).where("key is not null")
    met = written(keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"), "met")
    places = distinct.select("h", "h2", "first", F.posexplode("keys").alias("kind", "key")).where("key is not null")
    meets = places.join(met, "key", "left_semi")
    wanted = written(meets.groupBy("h", "h2").agg(F.first("first").alias("first"), F.collect_set("kind").alias("kinds")), "wanted")
    near = written(_texts(docs, wanted), "near")

    # Blocks are dealt before they grow into variants, which are made and shuffled once.
    varied = near.agg(F.sum(F.length("line").cast("long") * F.size("kinds"))).first()[0] or 0
    blocks = _blocks(near).repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-varied // VARIED)), "g", "g2")
    spread = blocks.select("first", F.explode(_variants(F.col("mid"), F.col("less"), F.col("at"), F.col("g"), F.col("g2"))).alias("x")).select("first", "x.*")
    here = F.struct("first", "place")
    earliest = lambda r: F.min(F.when(F.col("role") == r, here)).over(Window.partitionBy("v", "v2"))
    other = F.when(F.col("role") == 0, earliest(0)).when(F.col("role") == 1, earliest(2)).otherwise(earliest(1))
    # The earliest line that each line meets, and the place of the character in which they differ.
    found = F.struct(F.col("other.first").alias("near_to"), "role", F.when(F.col("role") == 1, F.col("other.place")).otherwise(F.col("place")).alias("place"))
    pairs = spread.withColumn("other", other).where("other.first < first").groupBy("first").agg(F.min(found).alias("f")).select("first", "f.*")
    mine = near.select("h", "h2", "first", "line")
    others = near.select(F.col("first").alias("near_to"), F.col("line").alias("other"))
    both = pairs.join(mine, "first").join(others, "near_to")
    cut = lambda c: F.concat(F.substring(c, F.lit(1), F.col("place")), F.substring(c, F.col("place") + 2, F.length(c)))
    left = F.when(F.col("role") == 1, F.col("line")).otherwise(cut("line"))
    right = F.when(F.col("role") == 2, F.col("other")).otherwise(cut("other"))
    return both.where((left == right) & (F.col("line") != F.col("other"))).select("h", "h2", "near_to")


def kept_lines(docs: DataFrame) -> DataFrame:
    """k1, k2, keep: the numbers of the lines that stay, in order, of every document with such lines (blank ones aside)."""
    distinct = written(distinct_lines(docs), "lines")
    stay = distinct.join(written(near_lines(docs, distinct), "near_lines"), ["h", "h2"], "left_anti")
    return stay.groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")).agg(F.array_sort(F.collect_list("first.no")).alias("keep"))


def _kept(lines: Column, keep: Column) -> Column:
    """The lines that stay, with the blank ones between them."""
    n = F.size(keep)

    def stretch(p: Column) -> Column:
        before = F.coalesce(F.get(keep, p - 1), F.lit(-1))
        stop = F.coalesce(F.get(keep, p), F.size(lines))
        blank = F.filter(F.slice(lines, before + 2, stop - before - 1), lambda x: x.rlike(_BLANK))
        return F.concat(blank, F.slice(lines, stop + 1, F.lit(1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), n), stretch))


def _cleaned(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text, l (lines), n_visible (lines that aren't blank), keep, out (the lines that stay)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit("k2")).alias("k2"))
    joined = rows.join(kept_lines(docs), ["k1", "k2"], "left").withColumns({"l": F.split("text", "\n"), "keep": F.coalesce("keep", F.array().cast("array<int>"))})
    seen = joined.withColumn("n_visible", F.size(F.filter("l", lambda x: ~x.rlike(_BLANK))))
    return seen.withColumn("out", F.when(F.col("n_visible") == F.size("keep"), F.col("l")).otherwise(_kept(F.col("l"), F.col("keep"))))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the text without its removed lines) of every row of docs.

    Null text: one empty line. Rows of equal id and text: equal results. Empty table: no rows. Other columns are ignored."""
    rows = _cleaned(docs)
    return rows.select("row.doc_id", F.size("l").cast("bigint").alias("n_lines"), (F.col("n_visible") - F.size("keep")).cast("bigint").alias("n_removed"), F.array_join("out", "\n").alias("kept"))


def rewrite(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text (and n_chars, if there) as the kept lines; documents of which only blank lines
    are left, after others were removed, go. Texts that lose nothing, null ones too, stay as they are."""
    rows = _cleaned(docs).withColumns({"cut": F.col("n_visible") > F.size("keep"), "new": F.array_join("out", "\n")})
    rows = rows.where(~F.col("cut") | (F.size("keep") > 0))
    names = {"text": F.when(F.col("cut"), F.col("new")).otherwise(F.col("row.text")), "n_chars": F.when(F.col("cut"), F.length("new")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0))}
    return rows.select(*(names[c].cast(docs.schema[c].dataType).alias(c) if c in names else F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the kept text, a row for each document; see dedup_lines for odd rows."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, no, line, length(line) AS n FROM (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
v AS (SELECT * FROM l WHERE regexp_matches(line, '[^\t-\r ]')),
e AS (SELECT line, n, min({'d': doc_id, 'n': no}) AS f FROM v GROUP BY line, n),
h AS (SELECT line, n, f, n // 2 AS s, n AS m FROM e UNION ALL SELECT line, n, f, (n - 1) // 2, n - 1 FROM e WHERE n >= 2),
p AS (SELECT DISTINCT a.line AS la, a.f AS fa, b.line AS lb, b.f AS fb FROM h a JOIN h b ON a.m = b.m AND left(a.line, a.s) = left(b.line, b.s) AND a.f < b.f
      UNION SELECT DISTINCT a.line, a.f, b.line, b.f FROM h a JOIN h b ON a.m = b.m AND right(a.line, a.m - a.s) = right(b.line, b.m - b.s) AND a.f < b.f),
q AS (SELECT DISTINCT lb, if(length(la) < length(lb), la, lb) AS x, if(length(la) < length(lb), lb, la) AS y FROM p WHERE abs(length(la) - length(lb)) <= 1),
-- edits of characters: levenshtein() counts bytes
g AS (SELECT DISTINCT lb AS line FROM q WHERE CASE WHEN length(x) = length(y) THEN len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) <= 1
        ELSE len(list_filter(range(1, length(y) + 1), lambda i: left(y, i - 1) || substr(y, i + 1) = x)) > 0 END),
x AS (SELECT v.doc_id, v.no, (e.f <> {'d': v.doc_id, 'n': v.no} OR g.line IS NOT NULL) AS gone FROM v JOIN e ON v.line = e.line LEFT JOIN g ON v.line = g.line)
SELECT l.doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE coalesce(gone, false)) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.no = x.no GROUP BY l.doc_id
"""
