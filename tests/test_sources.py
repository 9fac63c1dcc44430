"""Walks by tasks against walks on the driver, and contents that are read only where they are wanted."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from langlens.api import detect_tree
from langlens.operators.detect import on_paths
from langlens.sources import contents, files

TREE = {
    ".git/HEAD": "", ".gitignore": "*.log\n/top.txt\nbuild/\na/**/z.txt\nlogs/**\n!keep.log\n{x}.py\n", "top.txt": "", "sub/top.txt": "", "x.log": "", "keep.log": "", "sub/y.log": "",
    "build/out.c": "", "sub/build": "", "a/z.txt": "", "a/b/c/z.txt": "", "a/b/z.txt2": "", "logs/one/two.c": "", "x.py": "", "{x}.py": "", "sub/.ignore": "*.md\n!y.log\n", "sub/n.md": "", "n.md": "", "dir/a*b/c.c": "",
    "deep/er/and/er/f.rs": "fn x() {}\n", "vendor/v.js": "", "docs/d.py": "", ".hidden/h.py": "",
}


def put(folder, tree):
    for p, body in tree.items():
        (folder / p).parent.mkdir(exist_ok=True, parents=True)
        (folder / p).write_text(body)


@pytest.mark.parametrize("inside", ["", "sub", "a"])
@pytest.mark.parametrize("options", [{}, {"hidden": True}, {"ignore_files": False}, {"skipped": ["n.md", "sub"]}], ids=str)
def test_walked_equals_walk(spark, tmp_path, inside, options):
    put(tmp_path, TREE)
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    root = str(tmp_path / inside)
    got = sorted(tuple(r) for r in files.walked(spark, root, **options).collect())
    assert got == files.walk(root, **options) and (got or inside)


def test_walked_on_nothing(spark, tmp_path):
    assert files.walked(spark, str(tmp_path)).collect() == [] and files.walked(spark, str(tmp_path / "none")).collect() == []


def test_paths_both_ways(spark, tmp_path):
    put(tmp_path, TREE)
    both = [sorted(tuple(r) for r in files.paths(spark, str(tmp_path), distributed=d).collect()) for d in (False, True)]
    assert both[0] == both[1] and "vendor/v.js" not in dict(both[0]) and "docs/d.py" not in dict(both[0])


def opened(options):
    return sorted(p for f in Path(options["opened"]).glob("*") for p in f.read_text().splitlines())


def test_only_wanted_files_are_opened(spark, tmp_path):
    put(tmp_path / "t", TREE | {"q.h": "class x;", "w.h": "int a;", "run": "#!/bin/sh\n", "é/n.cs": "// x"})
    listed = files.paths(spark, str(tmp_path / "t"))
    open_ = on_paths(listed).where("language is null").select("path", "size")
    options = contents.deal(open_, str(tmp_path / "t")) | {"opened": str(tmp_path / "opened")}
    got = {r.path: bytes(r.content) for r in contents.read(spark, options).collect()}
    want = sorted(r.path for r in open_.collect())
    assert opened(options) == want == sorted(got) and len(want) < listed.count() and got["q.h"] == b"class x;"


@pytest.mark.parametrize("test,left", [
    ("path = 'f3'", 1), ("path in ('f1', 'f2', 'none')", 2), ("path like 'f1%'", 11), ("path like '%9'", 10), ("path like '%5%'", 19), ("size < 3", 3), ("size >= 98", 2), ("path > 'f5' and size <= 60", 15),
    ("path <> 'f3'", 99), ("length(path) = 2", 100), ("content is not null and path = 'f7'", 1),
])
def test_filters_are_pushed(spark, tmp_path, test, left):
    rows = [(f"f{i}", i) for i in range(100)]
    put(tmp_path / "t", {p: "x" * n for p, n in rows})
    listing = spark.createDataFrame(rows, "path string, size long").repartition(3)
    options = contents.deal(listing, str(tmp_path / "t"), target=500) | {"opened": str(tmp_path / "opened")}
    got = contents.read(spark, options).where(test).select("path", F.length("content").alias("n")).collect()
    want = {r.path for r in listing.withColumn("content", F.lit(b"")).where(test).collect()}
    assert {r.path for r in got} == want and all(r.n == int(r.path[1:]) for r in got)
    assert len(opened(options)) == left


def test_partitions_have_about_the_same_bytes(spark, tmp_path):
    sizes = [1000, 1, 1, 400, 900, 30, 30, 30, 5000, 2, 700, 700]
    listing = spark.createDataFrame([(f"f{i}", n) for i, n in enumerate(sizes)], "path string, size long").coalesce(1)
    reader = contents.Reader(contents.deal(listing, str(tmp_path), target=1000)["plan"], str(tmp_path), None)
    parts = [sum(r["size"] for b in reader.read(p) for r in b.to_pylist()) for p in reader.partitions()]
    assert sum(parts) == sum(sizes) and sorted(parts, reverse=True) == parts and all(p <= 1000 or p == 5000 for p in parts) and len(parts) <= 8


def test_unreadable_and_missing_files(spark, tmp_path):
    listing = spark.createDataFrame([("gone", 5), ("nul\0", 1), ("there", None)], "path string, size long")
    (tmp_path / "there").write_bytes(b"\xff\x00")
    got = {r.path: r.content for r in contents.read(spark, contents.deal(listing, str(tmp_path))).collect()}
    assert got == {"gone": None, "nul\0": None, "there": bytearray(b"\xff\x00")}
    none = spark.createDataFrame([], "path string, size long")
    assert contents.read(spark, contents.deal(none, str(tmp_path))).collect() == []


def test_trees_are_detected_both_ways(spark, tmp_path):
    put(tmp_path, TREE | {"q.h": "class x;", "run": "#!/bin/sh\n", "bad": ""})
    (tmp_path / "bad").write_bytes(b"#!/bin/sh\n\xff")
    both = [sorted(tuple(r) for r in detect_tree(spark, str(tmp_path), distributed=d).collect()) for d in (False, True)]
    assert both[0] == both[1] and ("run", "Shebang", "Shell", None) in both[0] and ("deep/er/and/er/f.rs", "Heuristics", "Rust", None) in both[0]
    assert next(r for r in both[0] if r[0] == "bad")[3]
