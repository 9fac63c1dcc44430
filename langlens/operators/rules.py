"""Ordered rules that tell languages of one extension apart by patterns in the text.

They are written as SQL text and parsed once: a column for each pattern, language and branch would take the driver
some thousand calls, which is longer than a run over ten thousand files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Catalog, builtin
from ..functions.patterns import java_pattern
from ..functions.text import literal


def condition(rule: object, text: str, named: dict) -> str:
    """SQL of a rule's condition on the text column of that name."""
    if rule is None:
        return "true"
    if isinstance(rule, str):
        return f"{text} RLIKE {literal(java_pattern(rule))}"
    if isinstance(rule, list):
        return condition(("any", *rule), text, named)
    op, *rest = rule
    if op == "named":
        return condition(named[rest[0]], text, named)
    if op == "not":
        return f"NOT ({condition(rest[0], text, named)})"
    return "(" + (" OR " if op == "any" else " AND ").join(condition(r, text, named) for r in rest) + ")"


def by_rules(extension: str, candidates: str, text: str, catalog: Catalog | None = None) -> Column:
    """The languages of the first rule of the extension that holds, among rules whose languages are all candidates;
    an empty array if none does. The arguments are names of columns."""
    catalog = catalog or builtin()
    array = lambda values: f"array({', '.join(map(literal, values))})"
    branches = []
    for extensions, rules in (x for x in catalog.rules if all(x)):
        # Flat CASE expressions: nested ones take the optimizer exponential time.
        block = "".join(f" WHEN size(array_except({array(langs)}, {candidates})) = 0 AND {condition(rule, text, catalog.named)} THEN {array(langs)}" for langs, rule in rules)
        branches.append(f" WHEN {extension} IN ({', '.join(map(literal, extensions))}) THEN CASE{block} END")
    none = "cast(array() AS array<string>)"
    return F.expr(f"coalesce(CASE{''.join(branches)} END, {none})" if branches else none)
