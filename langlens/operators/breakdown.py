"""Reports over detections (path, strategy, language): groups, counts, shares, order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, builtin
from ..functions.paths import any_match, strip_relative
from ..sources.store import shared_folder, stored

#: Types that the reports show.
SHOWN = ("markup", "programming")


def successful(detections: DataFrame) -> DataFrame:
    found = F.col("language").isNotNull()
    return detections.where(found & F.col("error").isNull() if "error" in detections.columns else found)


def shown(detections: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Detections of markup and programming languages."""
    table = (catalog or builtin()).languages_table(detections.sparkSession).where(F.col("type").isin(*SHOWN)).select("language")
    return successful(detections).join(F.broadcast(table), "language", "left_semi")


def language_breakdown(detections: DataFrame) -> DataFrame:
    """(language, n, files): files is a list of (strategy, path) in order of paths; all types."""
    return successful(detections).groupBy("language").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("path", "strategy"))).alias("files"))


def paged_breakdown(detections: DataFrame, page_rows: int = 10_000) -> DataFrame:
    """(language, page, path, strategy): language_breakdown in rows, page_rows files on each page, by path; all types.

    Files are dealt and sorted by language and path, so a language of any size is spread, and no more than a number for
    each task and language is counted to number them."""
    spark = detections.sparkSession
    rows = successful(detections).select("language", "path", "strategy").repartitionByRange("language", "path").sortWithinPartitions("language", "path", "strategy")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, language, place = TaskContext.get().partitionId(), None, 0
        for b in batches:
            places = []
            for x in b[0].to_pylist():
                language, place = x, place + 1 if x == language else 0
                places.append(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], ["language", "path", "strategy", "part", "place"])

    placed = stored(rows.mapInArrow(numbered, "language string, path string, strategy string, part long, place long"), shared_folder(spark, "pages"))
    before = Window.partitionBy("language").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("language", "part").agg(F.count("*").alias("n"))  # a row for each language of a task
    starts = counts.select("language", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    page = F.floor((F.col("start") + F.col("place")) / page_rows).cast("long")
    return placed.join(starts, ["language", "part"]).select("language", page.alias("page"), "path", "strategy")


def save_breakdown(detections: DataFrame, folder: str, page_rows: int = 10_000) -> None:
    """paged_breakdown as Parquet files under language=..., sorted by page and path."""
    pages = paged_breakdown(detections, page_rows)
    pages.repartitionByRange("language", "page").sortWithinPartitions("language", "page", "path").write.partitionBy("language").parquet(folder)


def language_split(detections: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """(language, n, percent) by falling count of files; equal counts by name."""
    counts = shown(detections, catalog).groupBy("language").agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())  # one row for each language
    return counts.withColumn("percent", share).orderBy(F.desc("n"), "language")


def split_lines(split: DataFrame) -> DataFrame:
    return split.select(F.format_string("%.2f%% %s", "percent", "language").alias("line"))


def file_breakdown(detections: DataFrame, filters: list[str] = (), catalog: Catalog | None = None) -> DataFrame:
    """(language, n, path): the files of every language that passes the filters, largest first."""
    rows = shown(detections, catalog).where(any_match(F.col("language"), list(filters)))
    counts = rows.groupBy("language").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(counts), "language").select("language", "n", strip_relative(F.col("path")).alias("path")).orderBy(F.desc("n"), "language", "path")


def strategy_breakdown(detections: DataFrame, filters: list[str] = (), catalog: Catalog | None = None) -> DataFrame:
    """(strategy, n, language, path): strategies that pass the filters, largest first; files by language and path."""
    rows = shown(detections, catalog).where(any_match(F.col("strategy"), list(filters)))
    counts = rows.groupBy("strategy").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(counts), "strategy").select("strategy", "n", "language", strip_relative(F.col("path")).alias("path")).orderBy(F.desc("n"), "strategy", "language", "path")
