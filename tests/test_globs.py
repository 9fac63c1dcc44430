"""Globs by an index against one regular expression for all of them."""

import random
import re

from pyspark.sql import functions as F

from langlens import fixed_values as fixed
from langlens.functions import paths
from langlens.plans import virtual

GLOBS = {"docs": fixed.DOCUMENTATION_GLOBS, "vendor": fixed.VENDOR_GLOBS, "odd": ["**/a/**", "x/*.c", "**/[a-c]z", "**/q?", "top", "**/{u,v}/w/**", "**/*", "**/{m*,n}"], "names": ["**/only", "**/[Aa]b"], "one": ["**/*.js"]}


def random_paths(globs, n=1500):
    rng = random.Random(9)
    pieces = sorted({x for g in globs for x in re.split(r"[/*,{}\\[\\]?]+", g) if x}) + ["a", "b.js", "x.css", "zz", "Docs", "min.js", "-min.js", "q1", "az", "w", "u", "c.c", "x"]
    for _ in range(n):
        yield "/".join("".join(rng.choice(pieces) for _ in range(rng.choice([1, 1, 1, 2, 3]))) for _ in range(rng.randint(1, 5)))


def test_index_equals_one_expression(spark):
    for name, globs in GLOBS.items():
        whole = re.compile("|".join(map(paths.glob_regex, globs)))
        table = spark.createDataFrame([(p,) for p in set(random_paths(globs))], "path string")
        rows = table.select("path", paths.matches(F.col("path"), globs).alias("m"), paths.excluded(F.col("path"), globs).alias("e")).collect()
        for r in rows:
            parts = r.path.split("/")
            assert r.m == bool(whole.match(r.path)), (name, r.path)
            assert r.e == any(whole.match("/".join(parts[: i + 1])) for i in range(len(parts))), (name, r.path)
        assert {r.e for r in rows} == {True, False} or name == "odd"


def test_the_expression_is_off_most_paths(spark):
    assert not paths.GlobIndex(fixed.DOCUMENTATION_GLOBS).always
    table = spark.createDataFrame([(f"src/pkg{i % 7}/file{i}.{e}",) for i in range(50) for e in ("py", "rs", "c", "h", "java", "go", "rb", "txt", "md")], "path string")
    assert table.where(paths.GlobIndex(fixed.VENDOR_GLOBS)._needed(F.split("path", "/"))).count() == 0
    files = virtual.files(spark, "/root/testdata/sf0.001")
    assert files.where(paths.GlobIndex(fixed.VENDOR_GLOBS)._needed(F.split("path", "/"))).count() < 0.5 * files.count()


def test_null_and_empty_paths(spark):
    rows = spark.createDataFrame([(None,), ("",), ("/",), ("docs/",), ("docs",)], "path string")
    got = [tuple(r) for r in rows.select(paths.matches(F.col("path"), fixed.DOCUMENTATION_GLOBS), paths.excluded(F.col("path"), fixed.DOCUMENTATION_GLOBS)).collect()]
    assert got[0] == (None, None) and got[1:] == [(False, False)] * 4
