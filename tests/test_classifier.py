"""The classifier's pick against scores of every candidate, with ties, hot tokens and languages without a model."""

import math
import random

import pytest
from pyspark.sql import functions as F

from langlens.catalog import builtin
from langlens.operators import bayes

LANGUAGES = ["L0", "L1", "L2", "L3", "L4", "L5", "untrained", "never"]


def model_rows():
    rng = random.Random(2)
    rows = [(k, t, math.log(rng.randint(1, 40) / 400)) for k in LANGUAGES[:5] for t in "abcdefgh" if rng.random() < 0.6]
    return rows + [("L5", t, p) for k, t, p in rows if k == "L4"]  # the same model twice: ties


def by_hand(rows, words, asked):
    logp = {(k, t): p for k, t, p in rows}
    known = {k for k, *_ in rows}
    score = lambda k: sum(logp.get((k, w), -19.0) for w in words) if k in known else -math.inf
    return max(asked, key=lambda k: (round(score(k), 9) if words or k not in known else 0.0, -asked.index(k)))


def files():
    rng = random.Random(4)
    out = []
    for i in range(120):
        words = [rng.choice("abcdefghxyz") for _ in range(rng.choice([0, 1, 5, 40]))]
        asked = rng.sample(LANGUAGES, rng.randint(0, len(LANGUAGES)))
        out.append((f"f{i}", " ".join(words), asked))
    return out + [("hot", "a " * 5000 + "b", ["L4", "L5", "L0"]), ("none", "zz", ["never", "untrained"]), ("null", None, ["never", "L3", "L2"])]


@pytest.mark.parametrize("bound", [bayes.BROADCAST_ROWS, 0], ids=["broadcast", "salted"])
def test_equals_scores_by_hand(spark, monkeypatch, bound):
    monkeypatch.setattr(bayes, "BROADCAST_ROWS", bound)
    model = spark.createDataFrame(model_rows(), "language string, token string, logp double")
    table = spark.createDataFrame(files(), "path string, text string, candidates array<string>").repartition(3)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    got = {r.path: r.language for r in bayes.decide(table, model, "path", "candidates", words, LANGUAGES).collect()}
    want = {p: by_hand(model_rows(), (t or "").split(), asked or LANGUAGES) for p, t, asked in files()}
    assert got == want
    dense = bayes.best(bayes.scores(table, model, "path", "candidates", words, LANGUAGES), "path")
    assert {r.path: r.language for r in dense.collect()} == want


def test_all_languages_make_no_row_each(spark):
    """553 candidates, few of which share a token: as many rows as files between the steps, and no shuffle by token."""
    names = list(builtin().languages)
    model = spark.createDataFrame([(names[i * 7 % 553], f"t{i % 50}", -2.0 - i % 3) for i in range(200)], "language string, token string, logp double")
    rows = [(f"f{i}", f"t{i % 50} t{i % 7} other", []) for i in range(40)] + [("empty", "", [])]
    table = spark.createDataFrame(rows, "path string, text string, candidates array<string>")
    out = bayes.decide(table, model, "path", "candidates", F.split("text", " "), names)
    logged = [(r.language, r.token, r.logp) for r in model.collect()]
    assert {r.path: r.language for r in out.collect()} == {p: by_hand(logged, t.split(" "), names) for p, t, _ in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan and "BroadcastHashJoin" in plan


def test_salted_plan_has_no_bare_token(spark, monkeypatch):
    monkeypatch.setattr(bayes, "BROADCAST_ROWS", 0)
    model = spark.createDataFrame(model_rows(), "language string, token string, logp double")
    table = spark.createDataFrame(files(), "path string, text string, candidates array<string>")
    by_token = model.groupBy("token").agg(F.collect_list(F.struct("language", "logp")).alias("of"))
    counted = table.select("path", F.col("candidates").alias("asked"), F.explode(F.split("text", " ")).alias("token")).groupBy("path", "asked", "token").agg(F.count("*").alias("n"))
    hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bayes._gains(counted, by_token, 1, "path")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)
    assert "hashpartitioning(token#" in plan and ", salt#" in plan.split("hashpartitioning(token#")[1].split(")")[0]


def test_only_rare_tokens_are_shuffled(spark, monkeypatch):
    """A model that is broadcast in part: the same picks, and no shuffle of each file's tokens (which took six times the
    input and, with 64 copies of the model, grew faster than it)."""
    monkeypatch.setattr(bayes, "BROADCAST_ROWS", len(model_rows()) - 1)
    model = spark.createDataFrame(model_rows(), "language string, token string, logp double")
    table = spark.createDataFrame(files(), "path string, text string, candidates array<string>").repartition(3)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = bayes.decide(table, model, "path", "candidates", words, LANGUAGES)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {r.path: r.language for r in out.collect()} == {p: by_hand(model_rows(), (t or "").split(), asked or LANGUAGES) for p, t, asked in files()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)
    dealt = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert "BroadcastHashJoin" in plan and any("token#" in x and "salt#" in x for x in dealt)
    assert not any("path#" in x and "token#" in x for x in dealt)
