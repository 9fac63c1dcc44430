"""Rules' patterns for Java: found in the same texts as the plain ones, in bounded time, with the line ends of PCRE."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from langlens import fixed_values as fixed
from langlens.functions.patterns import java_pattern
from langlens.operators.rules import by_rules

SIZE = 51_200


def listed(rule):
    if rule is None or isinstance(rule, str):
        return [] if rule is None else [rule]
    if isinstance(rule, tuple) and rule[0] == "named":
        return listed(fixed.NAMED[rule[1]])
    return [p for x in (rule[1:] if isinstance(rule, tuple) else rule) for p in listed(x)]


PATTERNS = list(dict.fromkeys(p for _, rules in fixed.RULES for _, c in rules for p in listed(c)))


def plain(pattern):
    """The pattern as it stands, with just what Java reads otherwise: bare braces and brackets in classes."""
    pattern = pattern.replace(r"[\s&&[^\n]]*", r"[\s&\[\^\n]\]*")
    return "(?m)" + re.sub(r"(?<!\\)\{(?!\d+(?:,\d*)?\})", r"\\{", pattern)


def compiled(spark, pattern):
    return spark._jvm.java.util.regex.Pattern.compile(pattern)


def texts(pattern, n, seed):
    """Random texts of the pattern's own words, blanks, line ends and letters."""
    rng = random.Random(seed)
    words = re.findall(r"[A-Za-z][A-Za-z_]+|[0-9]|[^\sA-Za-z0-9]", re.sub(r"\\[swdbz]|\[|\]|\(\?[a-z]*:|[?+*|^]", " ", pattern)) or ["a"]
    pieces = [*dict.fromkeys(words), " ", "  ", "\n", "\t", "\r\n", "\r", "a", "b9", "_", "\n\n", *".:(){}#;\"", "x.o", " :"]
    for _ in range(n):
        yield "".join(rng.choice(pieces) if rng.random() < 0.6 else rng.choice([" ", "\n", "a", "\n ", ".", ":"]) + rng.choice(words) for _ in range(rng.randint(0, 14)))


def test_found_in_the_same_texts(spark):
    assert set(fixed.LINEAR) <= set(PATTERNS)
    for i, p in enumerate(PATTERNS):
        old, new = compiled(spark, plain(p)), compiled(spark, java_pattern(p))
        for t in texts(p, 60, i):
            assert old.matcher(t).find() == new.matcher(t).find(), (p, t)


@pytest.mark.parametrize("unit", ["\n", " ", "a", "0", "\r\n", " \n", "a ", "a\n", "\t"], ids=repr)
def test_every_pattern_is_done_in_a_second(spark, unit):
    text = unit * (SIZE // len(unit))
    for p in PATTERNS:
        began = time.time()
        compiled(spark, java_pattern(p)).matcher(text).find()
        assert time.time() - began < 1, p


@pytest.mark.parametrize("text", ["match " + "a " * 25_000 + "with", "match " + "a " * 25_000, "case " + "a " * 25_000 + "of", "match a  with", "match with with", "case of of"])
def test_many_words_need_no_stack(spark, text):
    for p in PATTERNS:
        if r"(\S+\s)+" in p:
            word = p[-4:] if p.endswith("with") else "of"
            inner = re.search(r"(?:match|case)\s+(\S+(?:\s\S+)*)", text)
            want = p.startswith("=>") == text.startswith("case") and bool(inner) and re.search(r"^\S+(?:\s\S+)*?\s" + word, inner[1]) is not None
            assert compiled(spark, java_pattern(p)).matcher(text).find() == want, (p, text[:40])


def test_all_rules_on_long_rows(spark):
    """Rows of every extension with rules, as long as rules read: seconds for all of them."""
    rows = [(e, [x for langs, _ in rules for x in langs], u * (SIZE // len(u))) for exts, rules in fixed.RULES for e in exts[:1] for u in ("\n", " ", "a", "\r\n")]
    table = spark.createDataFrame(rows, "e string, c array<string>, t string").repartition(4)
    began = time.time()
    assert table.where(F.size(by_rules("e", "c", "t")) >= 0).count() == len(rows)
    assert time.time() - began < 60


LINES = [
    (r"^b", "a\rb", True), (r"^b", "a\r\nb", True), (r"^b", "a\nb", True), (r"^b", "a\u0085b", False), (r"^b", "a\u2028b", False), (r"^b", "a\u2029b", False), (r"a$", "a\u2028b", False), (r"a$", "a\rb", True), (r"a$", "a", True),
    (r"a.b", "a\u0085b", True), (r"a.b", "a\u2028b", True), (r"a.b", "a\rb", False), (r"a.b", "a\nb", False), (r"\bfn\b", "\u00e9fn", True), (r"\bfn\b", "fn\u00e9", True), (r"\bfn\b", "xfn", False), (r"\bfn\b", "(fn)", True),
    (r"^", "", True), (r"^x|^$", "a\n", False), (r"a{", "a{", True), (r"a{2}", "aa", True), (r"[[x]", "[", True), (r"[a&&b]", "&", True), (r"[]x]", "]", True), (r"^\s*x", " \r\n \n\tx", True), (r"^\s*x", "a x", False), (r"^\s*[^x]", "  x", True),
    (r"^(\s*x|y\s*)z", "\n\n xz", True), (r"\s*x", "   x", True), (r"\s*x|\s", " ", True), (r"^\s*( x|y)", "  x", True), (r"(?i)^\s*X\.y", "\n  x.Y", True), (r"a\.b", "axb", False), (r"\^\$", "^$", True), (r"[$^.]{2}", ".^", True),
]


@pytest.mark.parametrize("pattern,text,found", LINES)
def test_line_ends_words_and_classes(spark, pattern, text, found):
    assert compiled(spark, java_pattern(pattern)).matcher(text).find() == found
