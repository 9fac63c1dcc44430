"""Whole trees and single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, builtin
from .operators import bayes, breakdown
from .operators.detect import detect, on_paths
from .sources import contents, files


def detect_tree(spark: SparkSession, root: str, model: DataFrame | None = None, catalog: Catalog | None = None, **options) -> DataFrame:
    """Detections of all files under root: contents are read only for files that their path leaves open, and what the
    rules leave open is classified by model, or else by the one of the catalogue's samples."""
    model = bayes.trained(spark) if model is None else model
    first = on_paths(files.paths(spark, root, **options), catalog)
    settled = first.where(F.col("language").isNotNull()).select("path", "strategy", "language", F.lit(None).cast("string").alias("error"))
    rest = contents.read(spark, contents.deal(first.where(F.col("language").isNull()).select("path", "size"), root))
    return settled.unionByName(detect(rest, model, catalog))


def language_breakdown(spark: SparkSession, root: str, model: DataFrame | None = None, catalog: Catalog | None = None, **options) -> DataFrame:
    return breakdown.language_breakdown(detect_tree(spark, root, model, catalog, **options))


def language(name: str, catalog: Catalog | None = None):
    """Metadata of a language; KeyError("Language not found")."""
    return (catalog or builtin()).language(name)
