"""Naive Bayes over key tokens: no prior, no smoothing, a flat floor for unseen tokens."""

from __future__ import annotations

import io
import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import key_tokens
from ..sources.store import shared_folder, stored

UNSEEN = -19.0
#: Rows (language, token) of a model that may be broadcast: some 100 MB.
BROADCAST_ROWS = 2_000_000
#: Of a larger model the most frequent tokens are broadcast, so many rows at most; the others are joined by a shuffle.
FREQUENT_ROWS = 500_000
SALTS = 4


def fit(samples: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(language, token, logp) of samples (language, text): ln(count / all tokens of the language). A null text has
    no tokens. Counts combine before the shuffle; the totals reuse its result."""
    return of_counts(sample_counts(samples, tokens))


def sample_counts(samples: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(language, token, n) of samples (language, text): what a model is made of, and what can be added up."""
    tokens = key_tokens(F.col("text")) if tokens is None else tokens
    return samples.select("language", F.explode(tokens).alias("token")).groupBy("language", "token").agg(F.count("*").alias("n"))


class Model:
    """A model's counts as a table in a folder: versions that are written whole, the last one whole holds."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        names = [(x.getPath().getName(), x.getPath()) for x in store.listStatus(path)]
        done = [n for n, p in names if n.startswith("version=") and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def counts(self) -> DataFrame:
        """(language, token, n); empty before anything was added."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], "language string, token string, n long")
        return self.spark.read.schema("language string, token string, n long").parquet(f"{self.folder}/version={versions[-1]}")

    def add(self, counts: DataFrame) -> int:
        """Adds counts (language, token, n) as the next version: the same counts as if all samples had been counted at once."""
        version = max(self._versions(), default=0) + 1
        both = self.counts().unionByName(counts.select("language", "token", F.col("n").cast("long").alias("n")))
        both.groupBy("language", "token").agg(F.sum("n").alias("n")).write.parquet(f"{self.folder}/version={version}")
        return version

    def load(self) -> DataFrame:
        """The model (language, token, logp)."""
        return of_counts(self.counts())


def of_counts(counts: DataFrame) -> DataFrame:
    """The model of counts (language, token, n)."""
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "language").select("language", "token", F.log(F.col("n") / F.col("total")).alias("logp"))


def trained(spark: SparkSession) -> DataFrame:
    """The model of the catalogue's sample files: their key tokens are counted in samples_counts.parquet."""
    import pyarrow.parquet as pq

    return of_counts(spark.createDataFrame(pq.read_table(io.BytesIO(pkgutil.get_data("langlens", "samples_counts.parquet")))))


def scores(files: DataFrame, model: DataFrame, key: str, candidates: str, tokens: Column, all_languages: list[str] | None = None) -> DataFrame:
    """(key, language, ord, score) for every candidate: the sum over all token occurrences; -Infinity for a language
    without a model; 0 without tokens. Empty candidates mean all languages. Keys must be unique."""
    chosen = F.col(candidates)
    if all_languages:
        chosen = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(*map(F.lit, all_languages)))
    base = files.select(key, F.posexplode(chosen).alias("ord", "language"))
    counted = files.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    size = counted.groupBy(key).agg(F.sum("n").alias("all"))
    # Only tokens that the model has meet it; the others are what is left of the total.
    met = counted.join(model, "token").groupBy(key, "language").agg(F.sum(F.col("n") * (F.col("logp") - UNSEEN)).alias("gain"))
    trained = model.select("language").distinct().withColumn("trained", F.lit(True))
    out = base.join(size, key, "left").join(met, [key, "language"], "left").join(F.broadcast(trained), "language", "left")
    score = F.when(F.col("trained").isNull(), float("-inf")).otherwise(F.coalesce("gain", F.lit(0.0)) + UNSEEN * F.coalesce("all", F.lit(0)))
    return out.select(key, "language", "ord", score.alias("score"))


def best(scored: DataFrame, key: str) -> DataFrame:
    """(key, language): the highest score, the first candidate among equals."""
    return scored.groupBy(key).agg(F.max_by("language", F.struct("score", -F.col("ord"))).alias("language"))


def _frequent(by_token: DataFrame) -> int:
    """The least fourth of a logp, rounded down, of the tokens that are broadcast: as many as FREQUENT_ROWS takes."""
    rows = by_token.groupBy(_level().alias("level")).agg(F.sum(F.size("of")).alias("n")).collect()  # some 100 rows
    cut, room = 1, min(FREQUENT_ROWS, BROADCAST_ROWS)
    for r in sorted(rows, key=lambda r: -r.level):
        room -= r.n
        if room < 0:
            break
        cut = r.level
    return cut


def _level() -> Column:
    """How frequent a token is in the language that has most of it, by fourths of its logp."""
    return F.floor(F.array_max(F.transform("of", lambda x: x["logp"])) * 4)


def _gains(counted: DataFrame, by_token: DataFrame, size: int, key: str) -> DataFrame:
    """(key, met): the candidates that have a token of the file, with what each gains over the floor, and maybe others;
    by_token: token, of (language and logp of every language that has it), `size` of them in all. Rows of counted may
    repeat a token.

    A model of BROADCAST_ROWS rows at most goes to every task, so nothing is shuffled but a file's sums. Of a larger one
    only the frequent tokens do; the others, a small part of all occurrences, are joined by token and one of SALTS
    numbers of the file, so that a token that only the files have often is dealt over SALTS tasks."""
    sums, rare = [], None
    if size <= BROADCAST_ROWS:
        frequent = by_token
    else:
        cut = _frequent(by_token)
        frequent, rare = (by_token.where(_level() >= cut), by_token.where(_level() < cut)) if cut <= 0 else (None, by_token)
    if frequent is not None:
        of = frequent.select("token", F.inline("of"))
        sums.append(counted.join(F.broadcast(of), "token").where(F.array_contains("asked", F.col("language"))).select(key, "language", "n", "logp"))
    if rare is not None:
        left = counted if frequent is None else counted.join(F.broadcast(frequent.select("token")), "token", "left_anti")
        spread = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.select(key, "token", "n", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")).join(spread, ["token", "salt"])
        sums.append(joined.select(key, "n", F.inline("of")).select(key, "language", "n", "logp"))
    each = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    # Rounded, so that languages tie whatever the order of addition.
    gain = F.round(F.sum(F.col("n") * (F.col("logp") - UNSEEN)), 6)
    return each.groupBy(key, "language").agg(gain.alias("gain")).groupBy(key).agg(F.collect_list(F.struct("gain", "language")).alias("met"))


def decide(files: DataFrame, model: DataFrame, key: str, candidates: str, tokens: Column, all_languages: list[str] | None = None) -> DataFrame:
    """(key, language): what best() picks from scores(), without a row for every candidate.

    Candidates that share a token with the file are scored; all other trained ones tie at the floor, so the first of them
    stands for them; those without a model come last. Empty candidates mean all languages. Keys must be unique."""
    # A token has a row for each language at most.
    by_token = stored(model.groupBy("token").agg(F.collect_list(F.struct("language", "logp")).alias("of")), shared_folder(files.sparkSession, "model"))
    sizes = dict(by_token.select(F.explode("of.language").alias("language")).groupBy("language").count().collect())  # one row a language
    asked = F.col(candidates)
    if all_languages:
        asked = F.when(F.size(asked) > 0, asked).otherwise(F.array(*map(F.lit, all_languages)))
    base = files.select(key, asked.alias("asked"), tokens.alias("tokens"))
    # Every occurrence is a row that meets the model where it is read: counts of a file's tokens would be a shuffle of them all.
    counted = base.select(key, "asked", F.explode("tokens").alias("token")).withColumn("n", F.lit(1))
    met = F.filter(F.coalesce("met", F.expr("cast(array() as array<struct<gain:double,language:string>>)")), lambda x: F.array_contains("asked", x["language"]))
    place = lambda language: -F.array_position("asked", language)
    trained = F.array_intersect("asked", F.array(*map(F.lit, sorted(sizes))).cast("array<string>"))
    rest = F.array_except(trained, F.transform(met, lambda x: x["language"]))
    entry = lambda gain, language: F.struct(gain.alias("gain"), place(language).alias("place"), language.alias("language"))
    ranked = F.concat(F.transform(met, lambda x: entry(x["gain"], x["language"])), F.transform(F.slice(rest, 1, 1), lambda x: entry(F.lit(0.0), x)))
    out = base.select(key, "asked").join(_gains(counted, by_token, sum(sizes.values()), key), key, "left").where(F.size("asked") > 0)
    return out.select(key, F.coalesce(F.array_max(ranked)["language"], F.get("asked", 0)).alias("language"))


def classify(files: DataFrame, model: DataFrame, key: str = "path", text: str = "text", candidates: str = "candidates", all_languages: list[str] | None = None) -> DataFrame:
    return decide(files, model, key, candidates, key_tokens(F.col(text)), all_languages)

