"""The path cascade on a stream of files: stateless, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..catalog import Catalog
from ..operators.detect import on_paths


def detect_paths(stream: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """(path, strategy, language) of a streaming DataFrame with a path column, by name and extension alone."""
    return on_paths(stream.select("path"), catalog).select("path", "strategy", "language")
