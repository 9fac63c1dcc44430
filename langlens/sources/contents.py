"""A data source of files' contents: tasks of about the same bytes, and no file opened that a filter on its path leaves out.

    listing = contents.deal(paths, root)        # paths: path, size
    files = contents.read(spark, listing)       # path, size, content

The listing is a table in shared storage; its buckets hold `target` bytes of files at most, or one larger file. Each
bucket is a partition of the source. Filters on path and size are pushed into it (equality, lists, prefixes, ends, parts,
comparisons), so files that they leave out aren't opened; others stay with Spark. A file that can't be read has null
content. The root is a folder that all executors see.
"""

from __future__ import annotations

import json
import operator
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from .store import shared_folder, stored

NAME = "langlens_contents"
#: Bytes of files that a partition reads, and that a batch of rows holds.
TARGET, BATCH = 128 << 20, 16 << 20
_SCHEMA = "path string, size long, content binary"
_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: operator.eq, In: lambda x, values: x in values, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda x, part: part in x,
    LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge,
}


def deal(paths: DataFrame, root: str, target: int = TARGET) -> dict[str, str]:
    """The options of read() for paths (path, size): the listing, with a bucket for each run of `target` bytes of a task."""

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            buckets = []
            for size in b[1].to_pylist():
                if held and held + (size or 0) > target:
                    bucket, held = bucket + 1, 0
                held += size or 0
                buckets.append(bucket)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(buckets, pa.int64())], ["path", "size", "bucket"])

    spark = paths.sparkSession
    listing = stored(paths.select("path", F.col("size").cast("long").alias("size")).mapInArrow(bucketed, "path string, size long, bucket long"), shared_folder(spark, "listing"))
    # A row for each partition of the scan to come: what the driver plans with.
    spans = listing.groupBy("bucket", F.input_file_name().alias("file")).agg(F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "bucket").collect()
    plan = f"{shared_folder(spark, 'plan')}.json"
    store, place = pafs.FileSystem.from_uri(plan)
    store.create_dir(os.path.dirname(place), recursive=True)
    with store.open_output_stream(place) as out:
        out.write(json.dumps([[r["file"], r["bucket"]] for r in spans]).encode())
    return {"plan": plan, "root": root}


def read(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """path, size, content of a dealt listing. Switches pushing of filters into Python sources on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Contents)
    return spark.read.format(NAME).options(**options).load()


class Contents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return Reader(self.options["plan"], self.options["root"], self.options.get("opened"))


class Bucket(InputPartition):
    def __init__(self, file: str, number: int) -> None:
        self.file, self.number = file, number


class Reader(DataSourceReader):
    """opened: a folder in which each task leaves the list of the files it has opened, if one is given."""

    def __init__(self, plan: str, root: str, opened: str | None) -> None:
        self.plan, self.root, self.opened = plan, root, opened
        self.filters: list[tuple[bool, type, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner, wanted = (f.child, False) if isinstance(f, Not) else (f, True)
            if type(inner) in _TESTS and inner.attribute in (("path",), ("size",)):
                self.filters.append((wanted, type(inner), inner.attribute[0], inner.value))
            else:
                yield f

    def partitions(self) -> list[Bucket]:
        store, place = pafs.FileSystem.from_uri(self.plan)
        with store.open_input_stream(place) as f:
            return [Bucket(*x) for x in json.loads(f.read())]

    def _wanted(self, row: dict) -> bool:
        return all(row[name] is not None and _TESTS[kind](row[name], value) == wanted for wanted, kind, name, value in self.filters)

    def read(self, partition: Bucket | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty plan
            return
        store, place = pafs.FileSystem.from_uri(partition.file)
        with store.open_input_file(place) as f:
            rows = pq.read_table(f, columns=["path", "size"], filters=[("bucket", "=", partition.number)]).to_pylist()
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        held, size, opened = [], 0, []
        for row in filter(self._wanted, rows):
            try:
                opened.append(row["path"])
                row["content"] = Path(self.root, row["path"]).read_bytes()
            except (OSError, ValueError):
                row["content"] = None
            held.append(row)
            size += len(row["content"] or b"")
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)
        if self.opened and opened:
            Path(self.opened).mkdir(parents=True, exist_ok=True)
            Path(self.opened, uuid.uuid4().hex).write_text("\n".join(opened))
