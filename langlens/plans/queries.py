"""One query for each operator of the engine, over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..catalog import builtin
from ..functions import paths, text, tokens
from ..operators import bayes, breakdown, candidates, detect, rules
from ..sources.store import shared_folder, stored
from .virtual import FILES_SQL, files


def filename_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.by_filename(files(spark, sf_dir)).select("doc_id", "filename", F.col("by_filename").alias("language"))


def extension_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.by_extension(files(spark, sf_dir)).select("doc_id", "extension")


def extension_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.by_extension(files(spark, sf_dir)).select("doc_id", F.array_join("by_extension", ",").alias("candidates"), F.size("by_extension").cast("bigint").alias("n"))


def page_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("path"))
    return candidates.by_extension(pages).groupBy("extension").agg(F.count("*").alias("n"))


def path_filter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "path", paths.matches(F.col("path"), fixed.DOCUMENTATION_GLOBS).alias("matched"), paths.excluded(F.col("path"), fixed.DOCUMENTATION_GLOBS).alias("excluded"))


def path_filter_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "path", paths.matches(F.col("path"), fixed.VENDOR_GLOBS).alias("matched"), paths.excluded(F.col("path"), fixed.VENDOR_GLOBS).alias("excluded"))


def shebang_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = candidates.by_interpreter(files(spark, sf_dir), "content")
    return seen.select("doc_id", "interpreter", F.array_join("by_interpreter", ",").alias("languages"))


def candidate_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = candidates.by_interpreter(candidates.by_extension(files(spark, sf_dir)), "content")
    return seen.select("doc_id", F.array_join(candidates.narrow(F.col("by_extension"), F.col("by_interpreter")), ",").alias("left"))


def heuristic_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = candidates.by_extension(files(spark, sf_dir))
    return seen.select("doc_id", F.array_join(rules.by_rules("extension", "by_extension", "content"), ",").alias("languages"))


def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = text.truncated(F.col("text"), 500)
    return docs.select("doc_id", F.octet_length(cut).cast("bigint").alias("n_bytes"), cut.alias("head"))


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(tokens.tokens(F.col("text"))).alias("t"))
    return docs.groupBy("doc_id", "t.kind").agg(F.count("*").alias("n"), F.sum(F.length("t.text")).alias("chars"))


def tokenize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.explode(tokens.key_tokens(F.col("html"))).alias("token"))
    return pages.groupBy("token").agg(F.count("*").alias("n"))


def _words() -> Column:
    return F.filter(F.split(F.col("text"), "[ \n]+"), lambda w: (w != "") & (F.octet_length(w) <= tokens.MAX_TOKEN_BYTES))


def nb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("language"), "text")
    return bayes.fit(docs, _words()).select("language", "token", F.round("logp", 6).alias("logp"))


def nb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    model = bayes.fit(docs.where("doc_id % 5 <> 0").select(F.col("lang").alias("language"), "text"), _words())
    held = docs.where("doc_id % 5 = 0").withColumn("candidates", F.array(*map(F.lit, ["es", "en", "de", "fr"])))
    return bayes.decide(held, model, "doc_id", "candidates", _words())


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its own tokens as the classifier takes them; the model is fitted on all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Rows with a null or repeated id are documents too, so rows get a key; stored, as keys and tokens are read more than once.
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("lang").alias("language"), tokens.key_tokens(F.col("text")).alias("tokens"))
    rows = stored(rows, shared_folder(spark, "asked"))
    model = bayes.fit(rows, F.col("tokens"))
    asked = rows.select("key", "tokens", F.array(*map(F.lit, ["es", "en", "de", "fr"])).alias("candidates"))
    return rows.select("key", "doc_id").join(bayes.decide(asked, model, "key", "candidates", F.col("tokens")), "key", "left").select("doc_id", "language")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(files(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str, trained: bool = False) -> DataFrame:
    """Detections, stored: the reports that want them read them more than once."""
    found = detect.detect(files(spark, sf_dir), bayes.trained(spark)) if trained else _detected(spark, sf_dir)
    return stored(found, shared_folder(spark, "detections"))


def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(files(spark, sf_dir)).select("path", "strategy", "language")


def detect_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade: what the rules leave open goes to the classifier with the samples' model."""
    return detect.detect(files(spark, sf_dir), bayes.trained(spark)).select("path", "strategy", "language")


def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = breakdown.language_breakdown(_detected(spark, sf_dir))
    return out.select("language", "n", F.array_join(F.transform("files", lambda x: F.concat(x["path"], F.lit("="), x["strategy"])), " ").alias("files"))


def language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = breakdown.language_split(_detected(spark, sf_dir))
    return out.select("language", "n", F.round("percent", 6).alias("percent"))


def file_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.file_breakdown(_kept(spark, sf_dir))


def strategy_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.strategy_breakdown(_kept(spark, sf_dir))


def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.strategy_breakdown(_kept(spark, sf_dir), ["^Ext", "bang$"])


def language_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detected(spark, sf_dir).where("language is not null")
    return found.join(F.broadcast(builtin().languages_table(spark)), "language").groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("language").alias("languages"))


def trained_language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every language's files, by path, after the whole cascade."""
    return breakdown.paged_breakdown(_kept(spark, sf_dir, trained=True), 100)


def trained_language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.language_split(detect.detect(files(spark, sf_dir), bayes.trained(spark)))


def trained_file_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.file_breakdown(_kept(spark, sf_dir, trained=True))


def trained_strategy_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.strategy_breakdown(_kept(spark, sf_dir, trained=True))


QUERIES = [
    filename_lookup, extension_extract, extension_candidates, page_extensions, path_filter_docs, path_filter_vendor, shebang_language, candidate_narrow, heuristic_first_match, truncate_bytes,
    tokenize_documents, tokenize_pages, nb_train, nb_classify, classify_documents, detect_full, detect_trained, language_breakdown, language_split, file_breakdown, strategy_breakdown, header_filter, language_metadata,
    trained_language_breakdown, trained_language_split, trained_file_breakdown, trained_strategy_breakdown,
]


# SQL -------------------------------------------------------------------------------------------------------


def _table(pairs: list[tuple]) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'" if not isinstance(x, list) else "[" + ", ".join(map(quote, x)) + "]"
    return "VALUES " + ", ".join("(" + ", ".join(quote(x) for x in p) + ")" for p in pairs)


_C = builtin()
_BASE = f"""WITH {FILES_SQL},
known(extension, langs) AS ({_table(list(_C.extensions.items()))}),
names(filename, language) AS ({_table(list(_C.filenames.items()))}),
interps(interpreter, langs) AS ({_table(list(_C.interpreters.items()))}),
kinds(language, type) AS ({_table([(x.name, x.type) for x in _C.languages.values()])}),
f1 AS (SELECT *, regexp_extract(path, '[^/]+$') AS filename FROM files),
f2 AS (SELECT f1.*, (SELECT arg_max(k.extension, length(k.extension)) FROM known k
         WHERE ends_with(lower(regexp_replace(f1.filename, '^\\.', '')), k.extension) AND contains(regexp_replace(f1.filename, '^\\.', ''), '.')) AS extension FROM f1),
f3 AS (SELECT f2.*, coalesce(k.langs, CAST([] AS VARCHAR[])) AS by_ext, n.language AS by_name FROM f2 LEFT JOIN known k ON f2.extension = k.extension LEFT JOIN names n ON f2.filename = n.filename),
s1 AS (SELECT *, rtrim(split_part(content, chr(10), 1), chr(13)) AS line FROM f3),
s2 AS (SELECT *, regexp_split_to_array(trim(regexp_extract(line, '[^/]*$')), '[ \\t]+') AS w FROM s1),
s3 AS (SELECT *, CASE WHEN w[1] = 'env' THEN w[2] ELSE nullif(w[1], '') END AS cmd,
         regexp_extract(array_to_string(string_split(content, chr(10))[2:5], chr(10)), 'exec (\\w+).+\\$0.+\\$@', 1) AS hack FROM s2),
s4 AS (SELECT *, CASE WHEN starts_with(line, '#!') THEN regexp_extract(CASE WHEN cmd = 'sh' AND hack <> '' THEN hack ELSE cmd END, '^(.*?)(?:[0-9]\\.[0-9].*)?$', 1) END AS interpreter FROM s3),
s5 AS (SELECT s4.*, coalesce(i.langs, CAST([] AS VARCHAR[])) AS by_int FROM s4 LEFT JOIN interps i ON s4.interpreter = i.interpreter),
n1 AS (SELECT *, CASE WHEN len(by_ext) = 0 THEN by_int WHEN len(by_int) = 0 THEN by_ext
         WHEN len(list_filter(by_ext, lambda x: list_contains(by_int, x))) = 0 THEN by_ext ELSE list_filter(by_ext, lambda x: list_contains(by_int, x)) END AS narrowed FROM s5),
"""

# The rules of the extensions in the virtual table (see fixed_values.RULES), written out once more for RE2,
# so that the SQL doesn't rest on what it is to check; c: the candidates, t: the text.
_RULE_CASE = """CASE extension
 WHEN '.rs' THEN CASE WHEN list_contains(c, 'Rust') AND regexp_matches(t, '(?m)^(use |fn |mod |pub |macro_rules|impl|#!?\\[)') THEN ['Rust']
   WHEN list_contains(c, 'RenderScript') AND regexp_matches(t, '(?m)#include|#pragma\\s+(rs|version)|__attribute__') THEN ['RenderScript'] ELSE [] END
 WHEN '.ts' THEN CASE WHEN list_contains(c, 'XML') AND regexp_matches(t, '<TS\\b') THEN ['XML'] WHEN list_contains(c, 'TypeScript') THEN ['TypeScript'] ELSE [] END
 WHEN '.md' THEN CASE WHEN list_contains(c, 'Markdown') AND (regexp_matches(t, '(?m)(^[-A-Za-z0-9=#!\\*\\[|>])|<\\/') OR t = '') THEN ['Markdown']
   WHEN list_contains(c, 'GCC Machine Description') AND regexp_matches(t, '(?m)^(;;|\\(define_)') THEN ['GCC Machine Description'] WHEN list_contains(c, 'Markdown') THEN ['Markdown'] ELSE [] END
 WHEN '.h' THEN CASE WHEN list_contains(c, 'Objective-C') AND regexp_matches(t, '(?m)^\\s*(@(interface|class|protocol|property|end|synchronised|selector|implementation)\\b|#import\\s+.+\\.h[">])') THEN ['Objective-C']
   WHEN list_contains(c, 'C++') AND regexp_matches(t, '(?m)^\\s*#\\s*include <(cstdint|string|vector|map|list|array|bitset|queue|stack|forward_list|unordered_map|unordered_set|(i|o|io)stream)>|^\\s*template\\s*<|^[ \\t]*(try|constexpr)|^[ \\t]*catch\\s*\\(|^[ \\t]*(class|(using[ \\t]+)?namespace)\\s+\\w+|^[ \\t]*(private|public|protected):$|std::\\w+') THEN ['C++']
   WHEN list_contains(c, 'C') THEN ['C'] ELSE [] END
 WHEN '.properties' THEN CASE WHEN list_contains(c, 'INI') AND regexp_matches(t, '(?m)^[^#!;][^=]*=') AND regexp_matches(t, '(?m)^[;\\[]') THEN ['INI']
   WHEN list_contains(c, 'Java Properties') AND regexp_matches(t, '(?m)^[^#!;][^=]*=') AND regexp_matches(t, '(?m)^[#!]') THEN ['Java Properties']
   WHEN list_contains(c, 'INI') AND regexp_matches(t, '(?m)^[^#!;][^=]*=') THEN ['INI'] ELSE [] END
 WHEN '.cs' THEN CASE WHEN list_contains(c, 'Smalltalk') AND regexp_matches(t, '![\\w\\s]+methodsFor: ') THEN ['Smalltalk']
   WHEN list_contains(c, 'C#') AND regexp_matches(t, '(?m)^(\\s*namespace\\s*[\\w\\.]+\\s*\\{|\\s*\\/\\/)') THEN ['C#'] ELSE [] END
 ELSE CAST([] AS VARCHAR[]) END"""

_DETECT = (
    _BASE
    + f"""r1 AS (SELECT *, narrowed AS c, content AS t FROM n1),
r2 AS (SELECT *, CASE WHEN len(c) > 1 AND extension IS NOT NULL THEN {_RULE_CASE} ELSE CAST([] AS VARCHAR[]) END AS ruled FROM r1),
r3 AS (SELECT *, CASE WHEN len(ruled) = 0 THEN c WHEN len(list_filter(c, lambda x: list_contains(ruled, x))) = 0 THEN c ELSE list_filter(c, lambda x: list_contains(ruled, x)) END AS rest FROM r2),
d AS (SELECT path, CASE WHEN by_name IS NOT NULL THEN 'Filename' WHEN len(by_ext) = 1 THEN 'Extension' WHEN len(c) = 1 THEN 'Shebang' WHEN len(rest) = 1 THEN 'Heuristics' WHEN len(rest) > 1 THEN 'Classifier' END AS strategy,
   CASE WHEN by_name IS NOT NULL THEN by_name WHEN len(by_ext) = 1 THEN by_ext[1] ELSE rest[1] END AS language FROM r3),
sh AS (SELECT d.* FROM d JOIN kinds USING (language) WHERE type IN ('markup', 'programming'))
"""
)

# The globs of fixed_values that paths of the virtual table can meet, as regular expressions.
_DOC_DIRS = r"(^|/)([Dd]ocs|[Dd]oc|[Dd]ocumentation|[Gg]roovydoc|[Jj]avadoc|[Mm]an|[Ee]xamples|[Dd]emo|[Dd]emos|inst/doc|[Ss]amples?)/"
_DOC_FILES = r"(^|/)(CHANGE|CONTRIBUTING|COPYING|INSTALL|LICEN[CS]E|[Ll]icen[cs]e|README|[Rr]eadme)[^/]*$"
_VENDOR = r"(^|/)(vendor|node_modules|[Tt]es(t|ts)/fixtures)/|(^|/)[^/]*[.-]min\.js$|(^|/)jquery[^/]*\.js$|(^|/)configure$"
_WORDS_SQL = "SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[ \\n]+')) AS token FROM documents"
_MODEL_SQL = "w AS ({words}), k AS (SELECT * FROM w WHERE token <> '' AND strlen(token) <= 32), c AS (SELECT lang AS language, token, count(*) AS n FROM k {where} GROUP BY ALL), m AS (SELECT language, token, ln(n / sum(n) OVER (PARTITION BY language)) AS logp FROM c)"

ORACLES = {
    "filename_lookup": _BASE + "z AS (SELECT 1) SELECT doc_id, filename, by_name AS language FROM f3",
    "extension_extract": _BASE + "z AS (SELECT 1) SELECT doc_id, extension FROM f3",
    "extension_candidates": _BASE + "z AS (SELECT 1) SELECT doc_id, array_to_string(by_ext, ',') AS candidates, CAST(len(by_ext) AS BIGINT) AS n FROM f3",
    "page_extensions": f"WITH known(extension, langs) AS ({_table(list(_C.extensions.items()))}), p AS (SELECT regexp_replace(regexp_extract(url, '[^/]+$'), '^\\.', '') AS name FROM pages) "
    "SELECT (SELECT arg_max(k.extension, length(k.extension)) FROM known k WHERE ends_with(lower(name), k.extension) AND contains(name, '.')) AS extension, count(*) AS n FROM p GROUP BY 1",
    "path_filter_docs": f"WITH {FILES_SQL} SELECT doc_id, path, regexp_matches(path, '{_DOC_DIRS}') OR regexp_matches(path, '{_DOC_FILES}') AS matched, regexp_matches(path, '{_DOC_DIRS}') OR regexp_matches(path, '{_DOC_FILES}') AS excluded FROM files",
    "path_filter_vendor": f"WITH {FILES_SQL} SELECT doc_id, path, regexp_matches(path, '{_VENDOR}') AS matched, regexp_matches(path, '{_VENDOR}') AS excluded FROM files",
    "shebang_language": _BASE + "z AS (SELECT 1) SELECT doc_id, interpreter, array_to_string(by_int, ',') AS languages FROM s5",
    "candidate_narrow": _BASE + "z AS (SELECT 1) SELECT doc_id, array_to_string(narrowed, ',') AS \"left\" FROM n1",
    "heuristic_first_match": _BASE + f"r AS (SELECT doc_id, extension, by_ext AS c, content AS t FROM f3) SELECT doc_id, array_to_string({_RULE_CASE}, ',') AS languages FROM r",
    "truncate_bytes": "WITH c AS (SELECT doc_id, left(text, 500) AS h FROM documents), n AS (SELECT doc_id, h, list_max(list_filter(range(0, length(h) + 1), lambda k: strlen(left(h, k)) <= 500)) AS k FROM c) "
    "SELECT doc_id, CAST(strlen(left(h, k)) AS BIGINT) AS n_bytes, left(h, k) AS head FROM n",
    "nb_train": "WITH " + _MODEL_SQL.format(words=_WORDS_SQL, where="") + " SELECT language, token, round(logp, 6) AS logp FROM m",
    "nb_classify": "WITH " + _MODEL_SQL.format(words=_WORDS_SQL, where="WHERE doc_id % 5 <> 0") + ", l(language, ord) AS (VALUES ('es', 0), ('en', 1), ('de', 2), ('fr', 3)), "
    "q AS (SELECT doc_id, token, count(*) AS n FROM k WHERE doc_id % 5 = 0 GROUP BY ALL), "
    "s AS (SELECT d.doc_id, l.language, l.ord, coalesce(sum(q.n * coalesce(m.logp, -19)), 0) AS score FROM (SELECT doc_id FROM documents WHERE doc_id % 5 = 0) d CROSS JOIN l LEFT JOIN q ON d.doc_id = q.doc_id LEFT JOIN m ON m.language = l.language AND m.token = q.token GROUP BY ALL) "
    "SELECT doc_id, arg_max(language, {'s': round(score, 6), 'o': -ord}) AS language FROM s GROUP BY doc_id",
    "detect_full": _DETECT + "SELECT path, strategy, language FROM d",
    "language_breakdown": _DETECT + "SELECT language, count(*) AS n, string_agg(path || '=' || strategy, ' ' ORDER BY path) AS files FROM d WHERE language IS NOT NULL GROUP BY language",
    "language_split": _DETECT + "SELECT language, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM sh GROUP BY language",
    "file_breakdown": _DETECT + "SELECT language, count(*) OVER (PARTITION BY language) AS n, path FROM sh",
    "strategy_breakdown": _DETECT + "SELECT strategy, count(*) OVER (PARTITION BY strategy) AS n, language, path FROM sh",
    "header_filter": _DETECT + "SELECT strategy, count(*) OVER (PARTITION BY strategy) AS n, language, path FROM sh WHERE regexp_matches(strategy, '^Ext') OR regexp_matches(strategy, 'bang$')",
    "language_metadata": _DETECT + "SELECT type, count(*) AS n, count(DISTINCT language) AS languages FROM d JOIN kinds USING (language) GROUP BY type",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
