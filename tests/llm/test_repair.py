import hashlib
import itertools
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from langlens.llm import repair

from ..oracle import same

WS = " \t\n\x0b\x0c\r"
LEAD = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if n == 0:
            continue
        x = "" if n == 1 else "".join(k for k in x if k not in ".!?") if n == 2 else x
        out += [(c, t, "user" if n == 4 else r, x)] * (2 if n == 3 else 1)
    return out


def brute(rows, harm=True):
    """By conversation: a plain search over all edits, kept apart from the operator's automaton."""
    kept, out = damage(rows) if harm else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], []
    for conv in {c for c, *_ in rows}:
        mine = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in mine:
            body = text.strip(WS)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, q, room, mine=mine, faults=faults):
            """(cost, audit, repaired) from row i on; room: inserts in a row that are still allowed."""
            ways = [(0, "", ())] if i == len(mine) and q in ("", "a") else []
            if room:
                for to in "ua":
                    if (q, to) in LEAD:
                        n, audit, rows = best(i, to, room - 1)
                        ways.append((n + 2, "I" + audit, ((NAME[to], ""), *rows)))
            if i < len(mine):
                role, text = mine[i][2:]
                n, audit, rows = best(i + 1, q, 3)
                ways.append((n + 3, "D" + audit, rows))
                late = faults[i] == "truncated"
                if faults[i] in ("", "truncated"):
                    for to, name, cost, letter in ((role[:1], role, 0, "K"), ("u", "user", 2, "R"), ("a", "assistant", 2, "R")):
                        if (q, to) in LEAD:
                            n, audit, rows = best(i + 1, to, 3)
                            ways.append((n + cost + late, letter + audit, ((name, text), *rows)))
            return min(ways) if ways else (10**9, "", ())

        cost, audit, fixed = best(0, "", 3)
        turns = [r[1] for r in mine if r[1] is not None]
        first = [r[2][:1] for r in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(n) for n in ("rid", "kind", "audit", "first", "a.b")}).repartition(parts)


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 1, "user", "Hello?"), (1, 4, "assistant", "Yes"), (1, None, "user", "  \n"), (1, None, None, None), (2, 3, "assistant", "x"), (2, 4, "assistant", "x."),
    (2, 5, "", "no role."), (None, 1, "user", "Lost."), (None, None, "ubuntu", "Kept?"), (3, 0, "user", ""), (4, 9, "system", "a."), (4, 10, "system", "b."), (4, 11, "user", "a. "), (5, -5, "tool", "é "), (5, 7, "assistant", "¿Qué?"),
]


def rows_by_rule(conversations=60, longest=9):
    """Rows without ties in (conv_id, turn, role), by arithmetic."""
    out, roles = [], ["system", "user", "assistant", "user", "assistant", "tool", "user", None]
    texts = ["Fine.", "Well", "", "Why?", "Fine.", " \t", "No!", "Go on.", None]
    for c in range(conversations):
        for t in range(c % longest + 1):
            n = zlib.crc32(f"{c}/{t}".encode())
            out.append((c, None if n % 13 == 0 else t + n % 2 * (n % 7), roles[n // 7 % 8], texts[n // 64 % 9]))
    return out


@pytest.mark.parametrize("harm", [True, False])
@pytest.mark.parametrize("rows", [ODD, rows_by_rule(), [(7, t, "user" if t % 3 else "assistant", f"{t % 50}.") for t in range(150)]], ids=["odd", "rule", "long"])
def test_equals_plain_search(spark, rows, harm):
    got = [tuple(r) for r in repair.repair_stats(frame(spark, rows), damage=harm).collect()]
    assert sorted(got, key=str) == brute(rows, harm)


def test_repaired_rows_make_the_digest(spark):
    rows = rows_by_rule(20)
    want = {r[0]: r[-1] for r in brute(rows, False)}
    fixed = {}
    for r in sorted(repair.repaired(frame(spark, rows)).collect()):
        fixed.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(fixed.get(c, [])).encode()).hexdigest() for c in want} == want


def test_empty_table(spark):
    out = repair.repair_stats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), damage=True)
    assert out.count() == 0 and out.columns[-1] == "repaired_sha256"


def test_very_long_text_and_string_ids(spark):
    rows = [("x", 0, "user", "long " * 400_000 + "."), ("x", 1, "assistant", " " * 300_000 + "."), ("y", 0, "user", "." + " " * 300_000)]
    docs = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert sorted(tuple(r)[:-1] for r in repair.repair_stats(docs).collect()) == [("x", 0, 0, 0, 0, 0, 0, "KK"), ("y", 0, 0, 0, 0, 0, 2, "KI")]


def test_states_stay_few():
    machine = repair.Repairs()
    for n in range(3000):
        kinds = bytes(zlib.crc32(f"{n}:{i}".encode()) % 9 for i in range(n % 40))
        machine.repair(kinds)
    assert len(machine.vectors) < 200


@pytest.mark.parametrize("rows", [ODD, rows_by_rule(40)], ids=["odd", "rule"])
def test_sql(spark, tmp_path, rows):
    frame(spark, rows, 1).select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(f"{tmp_path}/conversations.parquet")
    same(repair.op13_structure_repair(spark, str(tmp_path)), repair.OP13_SQL, tmp_path)


def test_sql_on_the_tables(spark):
    same(repair.op13_structure_repair(spark, "/root/testdata/sf0.01"), repair.OP13_SQL, "/root/testdata/sf0.01")
