"""Cases of globs and rules whose results are fixed."""

import re

import pytest
from pyspark.sql import functions as F

from langlens import fixed_values as fixed
from langlens.functions import paths
from langlens.functions.text import literal
from langlens.operators.rules import by_rules

# Folders end in '/', as no file name is left of them.
IGNORED = [
    "cache/", "cache/file.ext", "first-dir/cache/file.ext", "Dependencies/module", "Dependencies/mod/file.ext", "dependencies/mod/file.ext", "some/configure", "configure",
    "dir/dirs/config.guess", "dir/dirs/config.sub", "dir/.yarn/releases/file.ext", "dir/some-min.js", "dir/some.min.js", "dir/some.min.css", "dir/microsoftAjax.js", "dir/microsoftajax.js",
]
KEPT = ["not-ignored/peep.ext", "folder/not-dependencies/module", "dir/dirs/configure/dirdir"]
RULED = [
    (".es", ["Erlang", "JavaScript"], "'use strict';", ["JavaScript"]),
    (".sql", ["PLSQL", "PLpgSQL", "SQL", "SQLPL", "TSQL"], "LALA THIS IS SQL", ["SQL"]),
    (".pro", ["Proguard", "Prolog", "INI", "QMake", "IDL"], "HEADERS SOURCES", ["QMake"]),
    (".pro", ["Proguard", "Prolog", "INI", "QMake", "IDL"], "HEADERS", []),
    (".ms", ["Roff", "Unix Assembly", "MAXScript"], ".include:", ["Unix Assembly"]),
    (".p", ["Gnuplot", "OpenEdge ABL"], "plot", ["Gnuplot"]),
    (".h", ["Objective-C", "C++"], "std::out", ["C++"]),
    (".man", ["Roff Manpage", "Roff"], "alskdjfahij", ["Roff"]),
    (".1in", ["Roff Manpage", "Roff"], '.TH LYXCLIENT 1 "@LYX_DATE@" "Version @VERSION@" "lyxclient @VERSION@"\n.SH NAME', ["Roff Manpage"]),
]


def test_vendored_paths():
    hit = lambda p: any(re.search(paths.glob_regex(g), p) for g in fixed.VENDOR_GLOBS)
    # What a folder's glob holds is the folder too: a walk doesn't enter it.
    assert [p for p in IGNORED if not hit(p + "x" if p.endswith("/") else p)] == []
    assert [p for p in KEPT if hit(p)] == []


def test_rules(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(RULED)], "i int, e string, c array<string>, t string, want array<string>")
    assert rows.where(by_rules("e", "c", "t") != F.col("want")).collect() == []


@pytest.mark.parametrize("value", ["", "'", "\\", "\\'", "a\\nb", "\n", '"', "%_", "é ", "\\\\''", "$x {y}", "r'z'"])
def test_literals(spark, value):
    assert spark.range(1).select(F.expr(literal(value))).first()[0] == value
