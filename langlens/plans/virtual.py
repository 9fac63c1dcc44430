"""A table of files made from the documents table by arithmetic on doc_id, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRS = ["src/", "", "docs/api/", "lib/vendor/", "node_modules/x/", "a/b/c/", "Demo/", "test/fixtures/", "my_docs/", "app/"]
EXTENSIONS = [".py", ".rs", ".ts", ".md", ".H", ".cmake.in", ".js", ".unknown", ".properties", ".cs", ".sh", ".json", "", ".min.js"]
NAMES = ["Makefile", "Dockerfile", "README.md", "makefile", ".bashrc", "jquery-1.2.js", "configure"]
PREFIXES = [
    "", "#!/usr/bin/env python2.6.3\n", "#!/bin/sh\n# x\nexec ruby -x \"$0\" \"$@\"\n", "#!/usr/bin/perl -w\n", " #!/bin/bash\n", "#!\n", "#!/usr/bin/env\n", "use std;\n", "fn x() {}\n",
    "#include <x>\n", "<TS version>\n", "a=b\n#c\n", "; a\nb=c\n", "// namespace\n", "std::vector x;\n", "@interface X\n", "#!/usr/bin/lua\r\n",
]


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    i = F.col("doc_id")
    name = F.when(i % 11 == 0, F.concat(i.cast("string"), F.lit("/"), _pick(NAMES, F.floor(i / 11)))).otherwise(F.concat(F.lit("f"), i.cast("string"), _pick(EXTENSIONS, i)))
    return docs.select("doc_id", F.concat(_pick(DIRS, F.floor(i / 3)), name).alias("path"), F.concat(_pick(PREFIXES, F.floor(i / 5)), F.coalesce("text", F.lit(""))).alias("content"))


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'" for v in values) + "]"


FILES_SQL = f"""files AS (SELECT doc_id,
  {_quoted(DIRS)}[(doc_id // 3) % {len(DIRS)} + 1] || CASE WHEN doc_id % 11 = 0 THEN doc_id || '/' || {_quoted(NAMES)}[(doc_id // 11) % {len(NAMES)} + 1]
    ELSE 'f' || doc_id || {_quoted(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] END AS path,
  {_quoted(PREFIXES)}[(doc_id // 5) % {len(PREFIXES)} + 1] || coalesce(text, '') AS content FROM documents)"""
