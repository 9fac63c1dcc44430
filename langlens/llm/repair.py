"""Conversation structure repair: the cheapest edits that turn a conversation's roles into `(s?(ua)+)?`.

Rows are letters of nine kinds; the pattern is an automaton of four states. A weighted automaton over the edits is
determinised as conversations come: the costs of finishing from each of the four states, less their least one, are a
state of the table, and its arcs are worked out once. Reading a conversation from its last row to its first through
the table gives the cost; going back along the tight arcs, smallest letter first, gives the audit, the least in ASCII
among the cheapest. Letters of an audit: Keep 0, Rerole to user or assistant 2, Delete 3 (the only way for a blank or
duplicate row), Insert an empty user or assistant row 2; a truncated row that isn't deleted costs 1 more.

A null role or text is one blank. Rows of a conversation are taken by turn, nulls first, then role and text; equal rows
are repeats, the second one a duplicate. Rows of a null conv_id are one conversation. Tables may be empty; other columns
are ignored, whatever their names. A conversation's rows stream through a task in their order, with a byte or two kept
for each; its texts are never held together. One SHA-256 of a conversation is sequential by nature, and so is its audit,
a single value; so one task reads a conversation, but nothing of it is held but the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: States of the pattern: nothing yet, after system, after user, after assistant; where a row of a role initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Where an inserted or a rerole row leads, and its role.
FREE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What it costs to end in each state: the inserts that are missing.
END = (0, 4, 2, 0)
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Kinds of rows: 2 * initial (s, u, a, other) + truncated; or one that must go.
INITIALS, MUST_GO = "sua-", 8
_BLANKS = "\t\n\x0b\x0c\r "


class Repairs:
    """The determinised automaton, as far as conversations have reached it."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.arcs: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self._number(END)

    def _number(self, vector: tuple[int, ...]) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    @staticmethod
    def _row(after: tuple[int, ...], kind: int, q: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost with what follows, next state) of the ways to take a row in state q, in order of letters."""
        yield "D", DELETE + after[q], q
        if kind != MUST_GO:
            extra, kept = kind % 2 * TRUNCATED, NEXT[q].get(INITIALS[kind // 2])
            if kept is not None:
                yield "K", extra + after[kept], kept
            yield "R", REROLE + extra + after[FREE[q]], FREE[q]

    def _before(self, after: tuple[int, ...], kind: int) -> list[int]:
        """The costs of finishing from each state before a row of that kind."""
        costs = [min(cost for _, cost, _ in self._row(after, kind, q)) for q in range(4)]
        for q in (USER, ASSISTANT, USER, SYSTEM, START):  # inserts before the row; two rounds of the only cycle
            costs[q] = min(costs[q], INSERT + costs[FREE[q]])
        return costs

    def arc(self, state: int, kind: int) -> tuple[int, int]:
        """(state, weight) before a row of that kind, from the state after it."""
        found = self.arcs.get((state, kind))
        if found is None:
            costs = self._before(self.vectors[state], kind)
            low = min(costs)
            found = self.arcs[state, kind] = self._number(tuple(c - low for c in costs)), low
        return found

    def trace(self, state: int, kind: int, q: int) -> tuple[str, int]:
        """(letters, next state of the pattern) of the least tight arcs from q over a row, from the state after it."""
        found = self.traces.get((state, kind, q))
        if found is None:
            after = self.vectors[state]
            costs, letters, at = self._before(after, kind), "", q
            while found is None:
                tight = {letter: to for letter, cost, to in self._row(after, kind, at) if cost == costs[at]}
                if "D" not in tight and INSERT + costs[FREE[at]] == costs[at]:
                    letters, at = letters + "I", FREE[at]
                else:
                    least = min(tight)
                    found = self.traces[state, kind, q] = letters + least, tight[least]
        return found

    def repair(self, kinds: bytes) -> tuple[int, str]:
        """The cost and the audit of a conversation's kinds of rows."""
        state, cost, states = self.end, 0, []
        for kind in reversed(kinds):
            states.append(state)
            state, weight = self.arc(state, kind)
            cost += weight
        cost += self.vectors[state][START]
        q, out = START, []
        for kind, after in zip(kinds, reversed(states), strict=True):
            letters, q = self.trace(after, kind, q)
            out.append(letters)
        return cost, "".join(out) + "I" * (END[q] // INSERT)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there of the rows after damage by crc32(conv_id:turn) % 20; a dropped row stays with
    `there` false, so that no conversation is lost."""
    conv, turn = F.col("conv_id"), F.col("turn")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(blank(F.col("role")))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank(F.col("text")), ".!?", "")).otherwise(blank(F.col("text")))
    there = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.explode(there).alias("there"))


def intact(rows: DataFrame) -> DataFrame:
    """Rows as damaged() returns them, without damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.lit(True).alias("there"))


def _faults(rows: DataFrame) -> DataFrame:
    """rows with rid, blank, duplicate and truncated, at most one of which is true: each row's first fault."""
    kept = F.rtrim("text", F.lit(_BLANKS))
    keys = {"k1": F.xxhash64("role", "text"), "k2": F.xxhash64("text", "role", F.lit("k2")), "blank": kept == "", "open": ~F.substring(kept, -1, 1).isin(".", "!", "?")}
    # Stored, so that a row keeps its number in every job, whatever executors are lost.
    stored = written(rows.withColumns(keys).withColumn("rid", F.monotonically_increasing_id()), "conversations")
    # Only rows that repeat have an entry; the least of them is no duplicate. Counted before the shuffle.
    first = stored.where("there and not blank").groupBy("conv_id", "k1", "k2").agg(F.min(F.struct("turn", "rid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c_"), F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), F.col("first.rid").alias("first"))
    met = stored.join(first, stored["conv_id"].eqNullSafe(first["c_"]) & (stored["k1"] == first["k1_"]) & (stored["k2"] == first["k2_"]) & stored["there"] & ~stored["blank"], "left")
    again = F.col("first").isNotNull() & (F.col("rid") != F.col("first"))
    return met.select("conv_id", "turn", "role", "text", "there", "rid", "blank", again.alias("duplicate"), (~F.col("blank") & ~again & F.col("open")).alias("truncated"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Whole conversations in a partition, one after another, their rows in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text", "rid")


_STATS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def audits(faulty: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of _faults()."""
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("blank") | F.col("duplicate"), MUST_GO).otherwise(2 * F.when(initial.isin("s", "u", "a"), F.instr(F.lit("sua"), initial) - 1).otherwise(3) + F.col("truncated").cast("int"))
    fault = F.when(F.col("blank"), 1).when(F.col("duplicate"), 2).when(F.col("truncated"), 3).otherwise(0)
    rows = faulty.select("conv_id", "turn", "role", "text", "rid", F.when(F.col("there"), kind).cast("int").alias("kind"), fault.cast("int").alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"))
    ordered = _in_order(rows).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "kind", "fault", "initial")
    out_type = f"conv_id {_type(faulty, 'conv_id')}, {_STATS}"

    def read(batches):
        machine, open_, kinds, conv = Repairs(), False, bytearray(), None
        low = high = before = None
        turns, faults, illegal, initial = 0, [0, 0, 0, 0], 0, None

        def ended():
            cost, audit = machine.repair(bytes(kinds))
            return conv, high - low + 1 - turns if turns else 0, *faults[1:], illegal, cost, audit

        def table(rows, like):
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            types = [like, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        like = None
        for batch in batches:
            like, done = batch.schema.field("conv_id").type, []
            for c, turn, kind, fault, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not open_ or c != conv:
                    if open_:
                        done.append(ended())
                    open_, conv, kinds = True, c, bytearray()
                    low = high = before = None
                    turns, faults, illegal, initial = 0, [0, 0, 0, 0], 0, None
                if kind is None:  # a dropped row
                    continue
                kinds.append(kind)
                faults[fault] += 1
                illegal += initial is not None and initial + first not in ("su", "ua", "au")
                initial = first
                if turn is not None:
                    turns += turn != before
                    low, high, before = turn if low is None else low, turn, turn
            if done:
                yield table(done, like)
        if open_:
            yield table([ended()], like)

    return ordered.mapInArrow(read, out_type)


def _applied(faulty: DataFrame, audited: DataFrame, digests: bool) -> DataFrame:
    """The audits applied to the rows: the repaired rows, or audited with repaired_sha256. An audit comes before its
    conversation's rows in the stream."""
    stats = [c for c in audited.columns if c != "conv_id"]
    none = lambda like, name: F.lit(None).cast(like.schema[name].dataType)
    head = audited.select("conv_id", F.lit(0).alias("kind"), none(faulty, "turn").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), none(faulty, "rid").alias("rid"), F.struct(*stats).alias("stats"))
    body = faulty.where("there").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "rid", none(head, "stats").alias("stats"))
    ordered = _in_order(head.unionByName(body), "kind").select("conv_id", "kind", "role", "text", "stats")
    conv = _type(faulty, "conv_id")
    schema = f"conv_id {conv}, {_STATS}, repaired_sha256 string" if digests else f"conv_id {conv}, place bigint, role string, text string, edit string"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        head, audit, at, q, place, digest = None, "", 0, START, 0, None

        def put(role, text, edit):
            nonlocal place
            if digests:
                digest.update((("\n" if place else "") + role + ":" + text).encode())
            else:
                out.append((conv_id, place, role, text, edit))
            place += 1

        def inserts():
            nonlocal at, q
            while audit[at : at + 1] == "I":
                q, at = FREE[q], at + 1
                put(ROLE[q], "", "I")

        def end():
            if head is not None:
                inserts()
                if digests:
                    out.append((conv_id, *head.values(), digest.hexdigest()))

        def table(rows, like):
            types = [like, *([pa.int64()] * 6 + [pa.string()] * 2 if digests else [pa.int64(), *[pa.string()] * 3])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        conv_id = like = None
        out = []
        for batch in batches:
            like = batch.schema.field("conv_id").type
            for c, kind, role, text, stats in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == 0:
                    end()
                    conv_id, head, audit, at, q, place = c, stats, stats["audit"], 0, START, 0
                    digest = hashlib.sha256() if digests else None
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    q = NEXT[q][role[:1]]
                    put(role, text, "K")
                elif edit == "R":
                    q = FREE[q]
                    put(ROLE[q], text, "R")
            if out:
                yield table(out, like)
                out = []
        end()
        if out:
            yield table(out, like)

    return ordered.mapInArrow(read, schema)


def repair_stats(rows: DataFrame, damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    faulty = _faults(damaged(rows) if damage else intact(rows))
    return _applied(faulty, written(audits(faulty), "audits"), digests=True)


def repaired(rows: DataFrame, damage: bool = False) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, role, text, edit (K, R or I)."""
    faulty = _faults(damaged(rows) if damage else intact(rows))
    return _applied(faulty, written(audits(faulty), "audits"), digests=False)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and repaired digest of every conversation of the table, after the contract's damage; a
    conversation without rows after damage has zeros, an empty audit and the digest of the empty string."""
    return repair_stats(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damage=True)


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(s) + 1), lambda k: CAST(ascii(s[k]) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"""


def _sql_row(q: int) -> str:
    """The cheapest, then least, way to take a row in state q; s0 to s3: (cost, audit) after it."""
    way = lambda to, cost, letter: f"{{'c': s{to}.c + {cost}, 'a': '{letter}' || s{to}.a}}"
    kept = " ".join(f"WHEN i = '{k}' THEN {way(to, 'late', 'K')}" for k, to in NEXT[q].items())
    delete = way(q, DELETE, "D")
    return f"CASE WHEN go THEN {delete} ELSE list_min([{delete}, CASE {kept} ELSE {delete} END, {way(FREE[q], f'{REROLE} + late', 'R')}]) END"


def _sql_insert(own: str, to: str) -> str:
    return f"list_min([{own}, {{'c': {to}.c + {INSERT}, 'a': 'I' || {to}.a}}])"


OP13_SQL = f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
n AS (SELECT *, {_CRC32} % 20 AS n FROM o),
d AS (SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE n WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM n),
p AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
x AS (SELECT *, body = '' OR again AS go, CASE WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS late, left(role, 1) AS i,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS i_ FROM p),
t AS (SELECT conv_id, max(pos) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(body = '') AS blank, count_if(body <> '' AND again) AS duplicate,
        count_if(NOT go AND late = 1) AS truncated, count_if(pos > 1 AND i_ || i NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
r AS (SELECT conv_id, rows + 1 AS pos, {{'c': 0, 'a': ''}} AS s0, {{'c': 4, 'a': 'II'}} AS s1, {{'c': 2, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM t
  UNION ALL SELECT conv_id, pos, {_sql_insert('b0', 'u')}, {_sql_insert('b1', 'u')}, u, a FROM (
    SELECT *, {_sql_insert('v', 'a')} AS u FROM (SELECT *, {_sql_insert('b3', 'v')} AS a FROM (SELECT *, {_sql_insert('b2', 'b3')} AS v FROM (
      SELECT r.conv_id, x.pos, {_sql_row(0)} AS b0, {_sql_row(1)} AS b1, {_sql_row(2)} AS b2, {_sql_row(3)} AS b3 FROM r JOIN x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.pos = r.pos - 1)))) z),
f AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM r WHERE pos = 1),
l AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM f),
e AS (SELECT conv_id, k, audit[k] AS letter, len(replace(audit[1:k], 'I', '')) AS pos, len(replace(audit[1:k], 'D', '')) - 1 AS j FROM l WHERE audit[k] <> 'D'),
g AS (SELECT e.*, x.role, x.text, max(CASE WHEN e.letter = 'K' AND x.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led FROM e LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.pos = e.pos AND e.letter <> 'I'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM g GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""
