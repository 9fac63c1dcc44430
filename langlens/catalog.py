"""Language catalogue: names, extensions, interpreters, rules.

`builtin()` is complete: all languages, extensions, file names and interpreters (languages.json) and all rules.
`load(folder)` reads another languages.yml, in the format of the widely used language catalogue, in its place, and the
heuristics.yml beside it, if there is one, in place of the rules; the folder is a parameter, or LANGLENS_CATALOG. What
it reads is validated. `save` writes a catalogue as Parquet tables, `read` reads them.
"""

from __future__ import annotations

import ast
import json
import os
import pkgutil
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import fixed_values as fixed


@dataclass(frozen=True)
class Language:
    name: str
    type: str
    color: str | None = None
    group: str | None = None


@dataclass
class Catalog:
    languages: dict[str, Language]
    filenames: dict[str, str]
    extensions: dict[str, list[str]]
    interpreters: dict[str, list[str]]
    rules: list[tuple[list[str], list[tuple[list[str], object]]]] = field(default_factory=list)
    named: dict[str, object] = field(default_factory=dict)

    def language(self, name: str) -> Language:
        """The language of that name; KeyError("Language not found") if there is none."""
        if name not in self.languages:
            raise KeyError("Language not found")
        return self.languages[name]

    # Catalogue tables: of fixed size, so joins with them may broadcast.
    def languages_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x.name, x.type, x.color, x.group) for x in self.languages.values()], "language string, type string, color string, grp string")

    def filenames_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.filenames.items()), "filename string, by_filename string")

    def extensions_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.extensions.items()), "extension string, by_extension array<string>")

    def interpreters_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.interpreters.items()), "interpreter string, by_interpreter array<string>")

    def rules_table(self, spark: SparkSession) -> DataFrame:
        rows = [(e, i, langs, None if c is None else repr(self._spelled(c))) for exts, rules in self.rules for e in exts for i, (langs, c) in enumerate(rules)]
        return spark.createDataFrame(rows, "extension string, rule_ord int, languages array<string>, condition string")

    def _spelled(self, rule: object) -> object:
        """A condition with its named patterns written out."""
        if isinstance(rule, tuple):
            return self._spelled(self.named[rule[1]]) if rule[0] == "named" else (rule[0], *map(self._spelled, rule[1:]))
        return rule

    def validate(self) -> None:
        """ValueError if a rule names an unknown pattern, has one that is no regular expression, or can't be reached. Rules of
        unknown languages never hold, as they are no candidates."""
        import regex

        from .functions.patterns import java_pattern

        def patterns(rule: object) -> list[str]:
            if rule is None or isinstance(rule, str):
                return [] if rule is None else [rule]
            if isinstance(rule, tuple) and rule[0] == "named":
                if rule[1] not in self.named:
                    raise ValueError(f"no pattern is named {rule[1]}")
                return patterns(self.named[rule[1]])
            return [p for x in (rule[1:] if isinstance(rule, tuple) else rule) for p in patterns(x)]

        for extensions, rules in self.rules:
            for i, (languages, rule) in enumerate(rules):
                if rule is None and any(set(x) <= set(languages) for x, _ in rules[i + 1 :]):
                    raise ValueError(f"{extensions[0]}: a rule after an open one for the same languages")
                for p in patterns(rule):
                    try:
                        regex.compile(java_pattern(p))
                    except regex.error as e:
                        raise ValueError(f"{extensions[0]}: {p!r}: {e}") from e

    def save(self, spark: SparkSession, folder: str) -> None:
        """The catalogue as Parquet tables."""
        for name in ("languages", "filenames", "extensions", "interpreters", "rules"):
            getattr(self, f"{name}_table")(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def _condition(rule: dict) -> object:
    """The condition of a rule of a heuristics.yml: None always holds."""
    parts = []
    if "and" in rule:
        parts.append(("all", *map(_condition, rule["and"])))
    if "pattern" in rule:
        parts.append(rule["pattern"])
    if "negative_pattern" in rule:
        parts.append(("not", rule["negative_pattern"]))
    if "named_pattern" in rule:
        parts.append(("named", rule["named_pattern"]))
    return None if not parts else parts[0] if len(parts) == 1 else ("all", *parts)


def _rules(read: dict) -> tuple[list, dict]:
    """Rules and named patterns of a heuristics.yml."""
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    rules = [([e.lower() for e in x["extensions"]], [(listed(r["language"]), _condition(r)) for r in x["rules"]]) for x in read.get("disambiguations") or ()]
    return rules, dict(read.get("named_patterns") or {})


def read(spark: SparkSession, folder: str) -> Catalog:
    """The catalogue that save wrote."""
    rows = lambda name: spark.read.parquet(f"{folder}/{name}").collect()  # noqa: E731  of fixed size
    out = Catalog({r.language: Language(r.language, r.type, r.color, r.grp) for r in rows("languages")}, {r.filename: r.by_filename for r in rows("filenames")}, {r.extension: list(r.by_extension) for r in rows("extensions")}, {r.interpreter: list(r.by_interpreter) for r in rows("interpreters")})
    rules: dict[str, list] = {}
    for r in sorted(rows("rules"), key=lambda r: r.rule_ord):
        rules.setdefault(r.extension, []).append((list(r.languages), None if r.condition is None else ast.literal_eval(r.condition)))
    out.rules = [([e], x) for e, x in rules.items()]
    return out


def _catalog(entries: dict[str, dict]) -> Catalog:
    """The catalogue of the entries of a languages.yml, with shared extensions and interpreters in tie order."""
    out = Catalog({}, {}, {}, {}, fixed.RULES, fixed.NAMED)
    for name, x in entries.items():
        out.languages[name] = Language(name, x["type"], x.get("color"), x.get("group"))
        for f in x.get("filenames") or ():
            out.filenames[f] = name
        for e in x.get("extensions") or ():
            out.extensions.setdefault(e.lower(), []).append(name)
        for i in x.get("interpreters") or ():
            out.interpreters.setdefault(i, []).append(name)
    for table, order in ((out.extensions, fixed.SHARED_EXTENSIONS), (out.interpreters, fixed.INTERPRETERS)):
        for k, langs in order.items():
            if sorted(table.get(k, ())) == sorted(langs):
                table[k] = list(langs)
    return out


@lru_cache(1)
def builtin() -> Catalog:
    return _catalog(json.loads(pkgutil.get_data(__package__, "languages.json")))


def load(folder: str | None = None) -> Catalog:
    """The catalogue in folder or LANGLENS_CATALOG, or else the built-in one."""
    folder = folder or os.environ.get("LANGLENS_CATALOG")
    if not folder:
        return builtin()
    import yaml

    out = _catalog(yaml.safe_load((Path(folder) / "languages.yml").read_text(encoding="utf-8")))
    if (rules := Path(folder) / "heuristics.yml").exists():
        out.rules, out.named = _rules(yaml.safe_load(rules.read_text(encoding="utf-8")))
    out.validate()
    return out
