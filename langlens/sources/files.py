"""Directory trees as (path, content) rows, and sample folders as training rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.paths import excluded, glob_regex
from .store import shared_folder, stored

SKIPPED = fixed.DOCUMENTATION_GLOBS + fixed.VENDOR_GLOBS


@lru_cache(4096)
def _ignore_rule(line: str) -> tuple[bool, bool, bool, re.Pattern]:
    """(negated, folders only, by name alone, pattern) of a line of an ignore file."""
    negated, p = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    folders, p = p.endswith("/"), p.rstrip("/")
    by_name = "/" not in p
    p = p.removeprefix("/")
    # Braces are plain characters here, unlike in globs.
    pattern = glob_regex(p.replace("{", "\0").replace("}", "\1")).replace(re.escape("\0"), r"\{").replace(re.escape("\1"), r"\}")
    return negated, folders, by_name, re.compile(pattern)


def _ignored(path: str, is_dir: bool, lines: list[tuple[str, str]]) -> bool:
    """The last ignore line that matches decides; lines: (folder of the ignore file, line), from the top down. A line
    with a slash before its end is for paths from its own folder on, others are for names at any depth."""
    verdict = False
    for base, line in lines:
        if base and not path.startswith(base + "/"):
            continue
        negated, folders, by_name, pattern = _ignore_rule(line)
        if folders and not is_dir:
            continue
        inside = path[len(base) + 1 :] if base else path
        if pattern.match(inside.rsplit("/", 1)[-1] if by_name else inside):
            verdict = not negated
    return verdict


def _ignore_lines(folder: str) -> list[str]:
    out = []
    for name in (".gitignore", ".ignore"):
        try:
            text = Path(folder, name).read_text(errors="replace")
        except OSError:
            continue
        out += [x.rstrip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return out


def _above(root: str) -> list[tuple[str, str]]:
    """(path from there to root, line) of the ignore files of the folders above root, up to the top of its repository."""
    out, here, rest = [], os.path.abspath(root), []
    if os.path.exists(os.path.join(here, ".git")):
        return []
    while (up := os.path.dirname(here)) != here:
        rest.insert(0, os.path.basename(here))
        here = up
        out = [("/".join(rest), x) for x in _ignore_lines(here)] + out
        if os.path.exists(os.path.join(here, ".git")):
            return out
    return []


Lines = list[tuple[str, str]]


class _Folder:
    """Lists one folder of a walk at a time."""

    def __init__(self, root: str, hidden: bool, ignore_files: bool, skipped: list[str]) -> None:
        self.root, self.hidden, self.ignore_files = root, hidden, ignore_files
        self.above = _above(root) if ignore_files else []
        self.skip = re.compile("|".join(map(glob_regex, skipped))) if skipped else None

    def entries(self, rel: str, lines: Lines) -> tuple[list[tuple[str, int]], list[str], Lines]:
        """(path, size) of the folder's files, the paths of the folders in it to be entered, and the ignore lines for them."""
        files, folders = [], []
        try:
            entries = sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name)
        except OSError:
            return files, folders, lines
        if self.ignore_files:
            lines = [*lines, *((rel, x) for x in _ignore_lines(os.path.join(self.root, rel)))]
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                is_dir = e.is_dir(follow_symlinks=False)
                if (e.name.startswith(".") and not self.hidden) or e.is_symlink() or (self.skip and self.skip.match(path)):
                    continue
                if lines and _ignored(path, is_dir, lines):
                    continue
                if any(_ignored(f"{prefix}/{path}", is_dir, [("", line)]) for prefix, line in self.above):
                    continue
                if is_dir:
                    folders.append(path)
                elif e.is_file(follow_symlinks=False):
                    files.append((path, e.stat().st_size))
            except OSError:
                continue
        return files, folders, lines


def walk(root: str, hidden: bool = False, ignore_files: bool = True, skipped: list[str] = ()) -> list[tuple[str, int]]:
    """(path relative to root, size) of regular files: hidden names, ignored paths and those that match a glob of
    skipped are left out, folders among them with all below; links aren't followed, unreadable folders and files that
    vanish meanwhile are left out. On the driver; walked() is the same for large trees."""
    folder, out, stack = _Folder(root, hidden, ignore_files, list(skipped)), [], [("", [])]
    while stack:
        files, folders, lines = folder.entries(*stack.pop())
        out += files
        stack += [(f, lines) for f in folders]
    return sorted(out)


_ARROW = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("base", pa.string()), ("line", pa.string())]))]
_FOUND = "path string, size long, folder boolean, lines array<struct<base:string,line:string>>"


def walked(spark: SparkSession, root: str, hidden: bool = False, ignore_files: bool = True, skipped: list[str] = (), parallelism: int | None = None) -> DataFrame:
    """walk() as a DataFrame, breadth first: in each round tasks list the folders that the round before found, which
    carry the ignore lines that hold for them. Rounds are tables in shared storage; the driver holds their counts alone.
    The root is a folder that all executors see."""
    skipped, n = list(skipped), parallelism or spark.sparkContext.defaultParallelism
    base = shared_folder(spark, "walk")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(root, hidden, ignore_files, skipped)
        for b in batches:
            for rel, lines in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                files, folders, below = folder.entries(rel, [(x["base"], x["line"]) for x in lines or ()])
                below = [{"base": a, "line": x} for a, x in below]
                rows = [(p, size, False, None) for p, size in files] + [(p, None, True, below) for p in folders]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], ["path", "size", "folder", "lines"])

    frontier, rounds = spark.createDataFrame([("", [])], "path string, lines array<struct<base:string,line:string>>"), 0
    while True:
        found = stored(frontier.repartition(n if rounds else 1).mapInArrow(listed, _FOUND), f"{base}/round={rounds}")
        rounds += 1
        frontier = found.where("folder").select("path", "lines")
        if frontier.isEmpty():
            break
    return spark.read.schema(_FOUND).parquet(base).where("not folder").select("path", "size")


def paths(spark: SparkSession, root: str, parallelism: int | None = None, distributed: bool | None = None, **options) -> DataFrame:
    """(path, size) of a tree without documentation and vendored paths; LANGLENS_THREADS or parallelism partitions. On a
    cluster, or if asked for, tasks walk the tree; on one machine the driver does, which is faster for small trees."""
    n = parallelism or int(os.environ.get("LANGLENS_THREADS") or 0) or spark.sparkContext.defaultParallelism
    if distributed is None:
        distributed = spark.conf.get("spark.master", "local").split("[")[0] != "local"
    if distributed:
        rows = walked(spark, root, skipped=SKIPPED, parallelism=n, **options)
    else:
        rows = spark.createDataFrame(walk(root, skipped=SKIPPED, **options), "path string, size long")
    return rows.where(~excluded(F.col("path"), SKIPPED)).repartition(n)


def with_content(listed: DataFrame, root: str) -> DataFrame:
    """Adds content (null where a file can't be read). Each task opens its own paths under root, a shared folder."""

    def read(batches):
        for pdf in batches:
            body = []
            for p in pdf["path"]:
                try:
                    body.append(Path(root, p).read_bytes())
                except OSError:
                    body.append(None)
            pdf["content"] = body
            yield pdf

    return listed.mapInPandas(read, f"{listed.schema.simpleString()[7:-1]}, content binary")


def tree(spark: SparkSession, location: str) -> DataFrame:
    """(path, content) of any folder that Spark can list; names that start with '_' or '.' are not listed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    return rows.select("path", "content")


def samples(spark: SparkSession, root: str, rename: dict[str, str] | None = None) -> DataFrame:
    """(language, path, text) of root/<language>/<file>: files of the first level only; rename maps folder names.

    Text that is no UTF-8 is empty."""
    rename = {"Fstar": "F*"} if rename is None else rename
    rows = [(rename.get(d.name, d.name), f"{d.name}/{f.name}") for d in sorted(Path(root).iterdir()) if d.is_dir() for f in sorted(d.iterdir()) if f.is_file()]
    read = with_content(spark.createDataFrame(rows, "language string, path string").repartition(spark.sparkContext.defaultParallelism), root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise("")
    return read.select("language", "path", text.alias("text"))
