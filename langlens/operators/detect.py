"""Detection of each file's language: cheap lookups on the path first, contents only for what they leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, builtin
from ..functions import text as texts
from ..functions.tokens import key_tokens
from ..sources.store import shared_folder, stored
from . import bayes, candidates
from .rules import by_rules


def on_paths(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Adds filename, extension, candidates, and strategy and language where the path alone decides; reads no content."""
    out = candidates.by_extension(candidates.by_filename(files, catalog), catalog).withColumnRenamed("by_extension", "candidates")
    single = F.size("candidates") == 1
    strategy = F.when(F.col("by_filename").isNotNull(), "Filename").when(F.col("filename").isNotNull() & single, "Extension")
    language = F.when(F.col("by_filename").isNotNull(), F.col("by_filename")).when(F.col("filename").isNotNull() & single, F.get("candidates", 0))
    return out.withColumns({"strategy": strategy, "language": language}).drop("by_filename")


def on_contents(opened: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """From (path, filename, extension, candidates, content) on: shebang, then rules on the first 51,200 bytes.

    Adds text, candidates as narrowed, strategy, language and error; several candidates left have the strategy
    Classifier and no language yet. Content that is no UTF-8 or null is an error."""
    read = opened.withColumn("whole", texts.as_text(F.col("content")))
    seen = candidates.by_interpreter(read, "whole", catalog)
    none = F.array().cast("array<string>")
    after = candidates.narrow(F.col("candidates"), F.col("by_interpreter"))
    seen = seen.withColumns({"after": after, "text": texts.truncated(F.col("whole"))})
    # Columns of their own, so that no expression holds the rules more than once.
    # Always true, and the same in every run; as it isn't to be moved, it keeps later filters and inferred constraints
    # above, which would repeat the rules.
    above = F.spark_partition_id() >= 0
    gate = (F.size("after") > 1) & F.col("extension").isNotNull() & above
    seen = seen.withColumn("ruled", F.when(gate, by_rules("extension", "after", "text", catalog)).otherwise(none))
    seen = seen.withColumn("left", candidates.narrow(F.col("after"), F.col("ruled")))
    bad = F.col("whole").isNull()
    strategy = F.when(bad | ~above, None).when(F.size("after") == 1, "Shebang").when(F.size("left") == 1, "Heuristics").when(F.size("left") > 1, "Classifier")
    language = F.when(~bad & above & (F.size("left") == 1), F.get("left", 0))
    out = seen.withColumns({"strategy": strategy, "language": language, "error": F.when(bad, "stream did not contain valid UTF-8"), "candidates": F.when(bad, none).otherwise(F.col("left"))})
    return out.drop("whole", "interpreter", "by_interpreter", "after", "ruled", "left")


def detect(files: DataFrame, model: DataFrame | None = None, catalog: Catalog | None = None) -> DataFrame:
    """(path, strategy, language, error) of files (path, content); paths must be unique.

    strategy and language are both null where nothing is known, and error is set where the content was needed and
    could not be read as UTF-8. Without a model every candidate scores alike, so the first one wins."""
    catalog = catalog or builtin()
    first = on_paths(files.select("path", "content"), catalog)
    named = F.col("filename").isNotNull()
    done = first.where(F.col("language").isNotNull() | ~named).select("path", "strategy", "language", F.lit(None).cast("string").alias("error"))
    opened = on_contents(first.where(F.col("language").isNull() & named).drop("strategy", "language"), catalog)
    if model is None:
        last = opened.withColumn("language", F.when(F.col("strategy") == "Classifier", F.get("candidates", 0)).otherwise(F.col("language")))
    else:
        # Stored, as it is read more than once; only undecided rows keep their text.
        open_ = F.col("strategy") == "Classifier"
        kept = opened.select("path", "strategy", "language", "error", F.when(open_, F.col("candidates")).alias("asked"), F.when(open_, F.col("text")).alias("text"))
        kept = stored(kept, shared_folder(files.sparkSession, "undecided"))
        picked = bayes.decide(kept.where(F.col("asked").isNotNull()), model, "path", "asked", key_tokens(F.col("text"))).withColumnRenamed("language", "picked")
        last = kept.join(picked, "path", "left").withColumn("language", F.coalesce("picked", "language"))
    return done.unionByName(last.select("path", "strategy", "language", "error"))
