"""langlens [PATH] [-b] [-s] [-c] [-f REGEX] [-n]: the language split of a tree."""

from __future__ import annotations

import argparse
import itertools
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import detect_tree
from .catalog import load
from .operators import breakdown
from .operators.bayes import Model
from .sources.store import shared_folder, stored


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    p = argparse.ArgumentParser(prog="langlens", description="The programming languages of a folder.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-b", "--breakdown", action="store_true", help="files of each language")
    p.add_argument("-s", "--strategies", action="store_true", help="files by the strategy that decided")
    p.add_argument("-c", "--condensed", action="store_true", help="headers only")
    p.add_argument("-f", "--filter", action="append", default=[], metavar="REGEX")
    p.add_argument("-n", "--no-color", action="store_true")
    p.add_argument("-m", "--model", metavar="FOLDER", help="a model that `train` made, in place of the built-in one")
    args = p.parse_args(argv)
    out = out or sys.stdout
    title = (lambda s: s) if args.no_color else lambda s: f"\033[35m{s}\033[0m"
    green = (lambda s: s) if args.no_color else lambda s: f"\033[32m{s}\033[0m"
    spark = spark or SparkSession.builder.appName("langlens").getOrCreate()
    catalog = load()
    model = Model(spark, args.model).load() if args.model else None
    found = detect_tree(spark, args.path, model, catalog)
    found = stored(found, shared_folder(spark, "detections"))
    for r in breakdown.language_split(found, catalog).collect():
        print(f"{r.percent:.2f}% {green(r.language)}", file=out)
    for wanted, name, rows in ((args.breakdown, "language", breakdown.file_breakdown), (args.strategies, "strategy", breakdown.strategy_breakdown)):
        if not wanted:
            continue
        print(file=out)
        for (head, n), group in itertools.groupby(rows(found, args.filter, catalog).toLocalIterator(), lambda r: (r[0], r.n)):
            print(f"{title(head)} ({n})", file=out)
            for r in group:
                if not args.condensed:
                    print(r.path if name == "language" else f"{r.path} ({green(r.language)})", file=out)
            if not args.condensed:
                print(file=out)
    return 0


def tokenize_file(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints the tokens of one file."""
    from .functions.tokens import tokens

    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        print("no file given", file=sys.stderr)
        return 1
    try:
        with open(argv[0], encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        print(f"{argv[0]}: not found", file=sys.stderr)
        return 1
    except UnicodeDecodeError:
        print(f"{argv[0]}: can't be read as UTF-8", file=sys.stderr)
        return 1
    except OSError as e:
        print(f"{argv[0]}: can't be opened: {e}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("langlens").getOrCreate()
    for t in spark.createDataFrame([(text,)], "text string").select(tokens(F.col("text")).alias("t")).first().t:
        print(t.kind, repr(t.text))
    return 0


def train(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Counts the samples of a folder (<language>/<file>) into a model's folder; run again, it adds to it."""
    from .operators.bayes import sample_counts
    from .sources.files import samples

    p = argparse.ArgumentParser(prog="langlens train", description="Adds labelled samples to a model.")
    p.add_argument("samples")
    p.add_argument("model")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("langlens").getOrCreate()
    model = Model(spark, args.model)
    version = model.add(sample_counts(samples(spark, args.samples)))
    languages, tokens = model.counts().agg(F.countDistinct("language"), F.count("*")).first()
    print(f"version {version}: {languages} languages, {tokens} counts", file=out or sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(train(sys.argv[2:]) if sys.argv[1:2] == ["train"] else main())
