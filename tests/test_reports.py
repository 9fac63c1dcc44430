"""Reports over the whole cascade, pages of a breakdown, and models that grow by added samples."""

import collections
import io

import pytest
from pyspark.sql import functions as F

from langlens import cli
from langlens.catalog import builtin
from langlens.operators import bayes, breakdown
from langlens.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return [tuple(r) for r in queries.detect_trained(spark, SF).where("language is not null").collect()]


def test_trained_reports(spark, found):
    types = {x.name: x.type for x in builtin().languages.values()}
    shown = [(p.removeprefix("./"), s, k) for p, s, k in found if types[k] in breakdown.SHOWN]
    by_language, by_strategy = collections.Counter(k for *_, k in shown), collections.Counter(s for _, s, _ in shown)
    rows = lambda name: sorted(tuple(r) for r in queries.queries()[name](spark, SF).collect())
    split = [(k, n, round(p, 9)) for k, n, p in rows("trained_language_split")]
    assert split == sorted((k, n, round(n * 100 / len(shown), 9)) for k, n in by_language.items())
    assert rows("trained_file_breakdown") == sorted((k, by_language[k], p) for p, _, k in shown)
    assert rows("trained_strategy_breakdown") == sorted((s, by_strategy[s], k, p) for p, s, k in shown)
    pages = []
    for k in {k for *_, k in found}:
        pages += [(k, i // 100, p, s) for i, (p, s) in enumerate(sorted((p, s) for p, s, x in found if x == k))]
    assert rows("trained_language_breakdown") == sorted(pages)


@pytest.mark.parametrize("n,page", [(2500, 100), (7, 3), (0, 5)])
def test_pages_of_one_large_language(spark, tmp_path, n, page):
    rows = spark.range(n).select(F.format_string("p%05d", F.col("id") * 7919 % 100_003).alias("path"), F.lit("Extension").alias("strategy"), F.when(F.col("id") % 10 < 9, "Big").otherwise("Small").alias("language"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = [tuple(r) for r in breakdown.paged_breakdown(rows.repartition(5), page).collect()]
    breakdown.save_breakdown(rows, f"{tmp_path}/pages", page)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for k in ("Big", "Small"):
        want += [(k, i // page, r.path, "Extension") for i, r in enumerate(sorted(rows.where(F.col("language") == k).collect()))]
    assert sorted(got) == want
    if n:
        assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/pages").select("language", "page", "path", "strategy").collect()) == want


def test_models_grow_by_added_samples(spark, tmp_path):
    texts = [("A", "x = y ( z )"), ("B", "let x in y"), ("A", "x x x"), ("C", None), ("B", ""), ("D", "new words here"), ("A", "y")]
    table = spark.createDataFrame(texts, "language string, text string")
    model = bayes.Model(spark, f"{tmp_path}/model")
    assert model.load().count() == 0
    for i in range(0, len(texts), 3):
        assert model.add(bayes.sample_counts(spark.createDataFrame(texts[i : i + 3], table.schema))) == i // 3 + 1
    tidy = lambda df: sorted((k, t, round(p, 12)) for k, t, p in df.collect())
    assert tidy(bayes.Model(spark, f"{tmp_path}/model").load()) == tidy(bayes.fit(table))
    (tmp_path / "model" / "version=9").mkdir()  # never ended
    assert tidy(bayes.Model(spark, f"{tmp_path}/model").load()) == tidy(bayes.fit(table))


def test_train_command(spark, tmp_path, capsys):
    for p, body in {"s/Limbo/a.b": "implement Cat; include module", "s/Brainfuck/b.b": "+ + - [ ] . ,", "t/x.b": "implement Dog; include module"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    out = io.StringIO()
    for version in (1, 2):
        assert cli.train([f"{tmp_path}/s", f"{tmp_path}/m"], spark, out) == 0
    assert out.getvalue().splitlines() == ["version 1: 2 languages, 11 counts", "version 2: 2 languages, 11 counts"]
    assert cli.main([f"{tmp_path}/t", "-n", "-m", f"{tmp_path}/m"], spark) == 0
    assert "100.00% Limbo" in capsys.readouterr().out
