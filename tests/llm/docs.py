"""Small documents with the odd cases: nulls, empty, blank, repeated, long, non-ASCII, clashing columns."""

BASE = [
    (1, "the cat sat on the mat and then it left the room for good\nSecond line here, with words."),
    (2, "the cat sat on the mat and then it left the room for good\nSecond line here, with words."),
    (2, "the cat sat on the mat and then it left the room for good\nSecond line here, with words."),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "Über größe 東京 don't 12345 €uro nbsp !!! end"),
    (None, "a null id keeps its row"),
    (7, "word " * 3000),
    (8, "THE CAT SAT ON THE MAT AND THEN IT LEFT THE ROOM FOR GOOD\nSecond line here, with words"),
    (9, "x"),
    (10, "".join(chr(97 + i * i % 26) for i in range(700))),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows=BASE, parts=3):
    rows = [(i, t, "x", 1) for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA + ", n_tokens string, slot int").repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, path, rows=BASE):
    frame(spark, rows).select("doc_id", "text").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)
