"""Lookups of candidate languages, and how one set of candidates narrows another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, builtin
from ..functions import paths, text

NONE = "cast(array() as array<string>)"


def narrow(previous: Column, new: Column) -> Column:
    """The new candidates if there were none; the previous ones if there are no new ones or none in common; else
    the common ones in the order of the previous."""
    common = F.array_intersect(previous, new)
    return F.when(F.size(previous) == 0, new).when(F.size(new) == 0, previous).when(F.size(common) == 0, previous).otherwise(common)


def by_filename(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Adds filename and by_filename: the language of the exact, case-sensitive name, or null."""
    catalog = catalog or builtin()
    named = files.withColumn("filename", paths.filename(F.col("path")))
    return named.join(F.broadcast(catalog.filenames_table(files.sparkSession)), "filename", "left")


def by_extension(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Adds extension (the longest known suffix, or null) and by_extension, its candidates in order."""
    catalog = catalog or builtin()
    named = files.withColumn("extension", paths.extension(paths.filename(F.col("path")), list(catalog.extensions)))
    out = named.join(F.broadcast(catalog.extensions_table(files.sparkSession)), "extension", "left")
    return out.withColumn("by_extension", F.coalesce("by_extension", F.expr(NONE)))


def by_interpreter(files: DataFrame, column: str = "text", catalog: Catalog | None = None) -> DataFrame:
    """Adds interpreter and by_interpreter from the shebang line of a text column."""
    catalog = catalog or builtin()
    named = files.withColumn("interpreter", text.interpreter(F.col(column)))
    out = named.join(F.broadcast(catalog.interpreters_table(files.sparkSession)), "interpreter", "left")
    return out.withColumn("by_interpreter", F.coalesce("by_interpreter", F.expr(NONE)))
