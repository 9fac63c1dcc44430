"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of its neighbours; the forward-backward
marginals of "good", weighted by line length, make the document's quality, and a logistic curve fitted on
the training documents maps that to a score. Empty texts and texts without visible lines get the share of
good training documents. Labels, language, source and id are no inputs.

The fit takes one row for each of at most TRAIN_DOCUMENTS labelled ids, in one executor's task, which holds numbers of
features alone; texts are scanned in pieces cut at line ends. Without labels, or with labels of one class, every score
is the share of good ones, (good + 1) / (labelled + 2). Null texts are empty texts. Rows with null ids are scored, their
held_out is null. Repeated rows are scored alike. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, RollingHash, documents, flat, spans, steps, trim, words

#: Bound of the training sample: labelled documents, those with the smallest hashes of their ids.
TRAIN_DOCUMENTS = 3000
THRESHOLD = 0.3
FOLDS = 5


def _kinds() -> np.ndarray:
    """Byte classes: upper, lower or non-ASCII, digit, space, sentence marks, other marks."""
    kind = np.full(256, 5, np.uint8)
    kind[65:91] = 0
    kind[97:123] = 1
    kind[128:] = 1
    kind[48:58] = 2
    kind[[32, 9, 11, 12, 13]] = 3
    kind[[ord(c) for c in ".,;:?'\"()-"]] = 4
    return kind


_KIND = _kinds()
_CUTS = {  # feature -> limits of its bins
    "length": (20, 60, 150, 400, 1000),
    "upper": (0.02, 0.08, 0.3, 0.6),
    "letters": (0.5, 0.7, 0.8, 0.9),
    "digits": (0.001, 0.05, 0.2),
    "space": (0.05, 0.1, 0.14, 0.18, 0.22),
    "sentence": (0.001, 0.01, 0.04, 0.1),
    "marks": (0.0001, 0.01, 0.03, 0.08, 0.15),
    "mark_runs": (0.01, 0.1, 0.3, 0.6),
    "word_length": (2.5, 4, 5.5, 7, 9),
    "same_as_last": (0.01, 0.05, 0.2, 0.5),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.95),
    "lone_marks": (0.01, 0.1, 0.3),
}
N_BINS = sum(len(c) + 1 for c in _CUTS.values())
N_FEATURES = 3 * (N_BINS + 1)


def _own(raw: np.ndarray, at: np.ndarray, roll: RollingHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every non-blank line: its row, its length, and the numbers of its own features."""
    start, end = spans(raw != 10, at)
    wstart, wend, _ = words(raw, at)
    # A word belongs to the line that it starts in: words hold no line feed.
    line_of = np.searchsorted(start, wstart, "right") - 1
    n_words = np.bincount(line_of, minlength=len(start))[: len(start)]
    keep = n_words > 0
    if not keep.all():
        renumber = np.cumsum(keep) - 1
        start, end, n_words, line_of = start[keep], end[keep], n_words[keep], renumber[line_of]
    n = len(start)
    doc = np.searchsorted(at, start, "right") - 1
    length = end - start
    own = np.empty((n, len(_CUTS)), np.int16)
    if not n:
        return doc, length, own
    kind = _KIND[raw]
    counts = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    def part(mask: np.ndarray) -> np.ndarray:
        c = counts(mask)
        return (c[end] - c[start]) / length

    marks = counts(kind == 5)
    hashes = roll.slices(roll.prefix(raw), wstart, wend)
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    same = np.zeros(len(wstart))
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    ends_in_mark = (kind[wend - 1] == 5) & (wend - wstart > 1)
    lone = marks[wend] - marks[wstart] == wend - wstart
    by_line = lambda x: np.add.reduceat(x.astype(float), first) / n_words
    order = np.lexsort((hashes, line_of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    values = {
        "length": lambda: length,
        "upper": lambda: part(kind == 0),
        "letters": lambda: part(kind <= 1),
        "digits": lambda: part(kind == 2),
        "space": lambda: part(kind == 3),
        "sentence": lambda: part(kind == 4),
        "marks": lambda: (marks[end] - marks[start]) / length,
        "mark_runs": lambda: by_line(ends_in_mark),
        "word_length": lambda: by_line(wend - wstart),
        "same_as_last": lambda: by_line(same),
        "distinct": lambda: by_line(new),
        "lone_marks": lambda: by_line(lone),
    }
    base = 0
    for k, (name, cuts) in enumerate(_CUTS.items()):
        own[:, k] = base + np.searchsorted(cuts, values[name](), "right")
        base += len(cuts) + 1
    return doc, length, own


def _pieces(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most STEP_BYTES that end with a row or a line, or one line."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(lo + STEP_BYTES, n)
        if hi < n and hi not in at[np.searchsorted(at, hi) :][:1]:
            feeds = np.flatnonzero(raw[lo:hi] == 10)
            row = int(at[np.searchsorted(at, hi, "right") - 1])
            hi = max(lo + int(feeds[-1]) + 1 if len(feeds) else lo, row)
            if hi <= lo:
                later = np.flatnonzero(raw[lo + STEP_BYTES :] == 10)[:1] + lo + STEP_BYTES + 1
                hi = min(int(at[np.searchsorted(at, lo, "right")]), int(later[0]) if len(later) else n)
        yield lo, hi
        lo = hi


def line_features(raw: np.ndarray, at: np.ndarray, roll: RollingHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every non-blank line: its document, its length, and the numbers of its active features (own, previous, next)."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(_CUTS)), np.int16))]
    for lo, hi in _pieces(raw, at):
        first, last = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
        doc, length, own = _own(raw[lo:hi], np.clip(at[first : last + 1], lo, hi) - lo, roll)
        parts.append((doc + first, length, own))
    doc, length, own = (np.concatenate(x) for x in zip(*parts))
    if not len(doc):
        return doc, length, np.zeros((0, 3 * len(_CUTS)), np.int16)
    edge = np.full((1, len(_CUTS)), N_BINS, np.int16)
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    turn = np.flatnonzero(doc[1:] != doc[:-1])
    before[turn + 1] = N_BINS
    after[turn] = N_BINS
    return doc, length, np.concatenate([own, before + np.int16(N_BINS + 1), after + np.int16(2 * (N_BINS + 1))], 1)


def _scores(w: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Log-odds of lines: the sum of the weights of their active features."""
    out = np.zeros(len(active))
    for k in range(active.shape[1]):
        out += w[active[:, k]]
    return out


def _grid(doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents of like numbers of lines together: (lines x documents) indices and which of them exist."""
    if not len(doc):
        return
    first = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    size = np.diff(np.concatenate([first, [len(doc)]]))
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(size[order], 1.3 * size[order[lo]] + 2, "right"))
        pick = order[lo:hi]
        t = np.arange(int(size[pick].max()))[:, None]
        there = t < size[pick]
        yield np.where(there, first[pick] + t, first[pick]), there
        lo = hi


def forward_backward(score: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of "good" for every line, expected transitions, and the log partition.

    score: log-odds of good over bad from a line's features; trans: 2 x 2 log weights."""
    out, moves, logz = np.zeros(len(score)), np.zeros((2, 2)), 0.0
    add = np.logaddexp
    for index, there in _grid(doc):
        s, (n, m) = score[index], index.shape
        f, b = np.zeros((n, 2, m)), np.zeros((n, 2, m))
        f[0, 1] = s[0]
        for t in range(1, n):
            a0 = add(f[t - 1, 0] + trans[0, 0], f[t - 1, 1] + trans[1, 0])
            a1 = add(f[t - 1, 0] + trans[0, 1], f[t - 1, 1] + trans[1, 1]) + s[t]
            f[t, 0], f[t, 1] = np.where(there[t], a0, f[t - 1, 0]), np.where(there[t], a1, f[t - 1, 1])
        for t in range(n - 2, -1, -1):
            b0 = add(trans[0, 0] + b[t + 1, 0], trans[0, 1] + s[t + 1] + b[t + 1, 1])
            b1 = add(trans[1, 0] + b[t + 1, 0], trans[1, 1] + s[t + 1] + b[t + 1, 1])
            b[t, 0], b[t, 1] = np.where(there[t + 1], b0, b[t + 1, 0]), np.where(there[t + 1], b1, b[t + 1, 1])
        z = add(f[-1, 0], f[-1, 1])
        logz += float(z.sum())
        out[index[there]] = np.exp(f[:, 1] + b[:, 1] - z)[there]
        for i in (0, 1):
            for j in (0, 1):
                x = np.exp(f[:-1, i] + trans[i, j] + (s[1:] if j else 0) + b[1:, j] - z)
                moves[i, j] += float(x[there[1:]].sum())
    return out, moves, logz


def _quality(score: np.ndarray, doc: np.ndarray, length: np.ndarray, n: int, trans: np.ndarray) -> np.ndarray:
    """Length-weighted marginals of n documents; nan without lines."""
    good, _, _ = forward_backward(score, doc, trans)
    total = np.bincount(doc, length, n)
    with np.errstate(invalid="ignore"):
        return np.where(total > 0, np.bincount(doc, good * length, n) / total, np.nan)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit(texts: list[str], good: list[int], rounds: int = 120, rate: float = 0.08, decay: float = 1e-3) -> dict:
    """Maximum likelihood by Adam, each line taking its document's label, then the logistic curve."""
    raw, at = flat(pa.array(texts, pa.large_string()))
    return fit_lines(*line_features(raw, at, RollingHash()), np.asarray(good, float), rounds, rate, decay)


def fit_lines(doc: np.ndarray, length: np.ndarray, active: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.08, decay: float = 1e-3) -> dict:
    """fit, from the lines' features."""
    prior = float((label.sum() + 1) / (len(label) + 2))
    w, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    if not len(doc) or len(np.unique(label)) < 2:
        return {"w": w, "trans": trans, "a": 0.0, "b": float(np.log(prior / (1 - prior))), "prior": prior}
    y = label[doc]
    truth = np.zeros((2, 2))
    inside = doc[1:] == doc[:-1]
    np.add.at(truth, (y[:-1][inside].astype(int), y[1:][inside].astype(int)), 1)
    theta, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for step in range(1, rounds + 1):
        w, trans = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        p, moves, _ = forward_backward(_scores(w, active), doc, trans)
        grad = sum(np.bincount(active[:, k], y - p, N_FEATURES) for k in range(active.shape[1]))
        g = np.concatenate([grad, (truth - moves).ravel()]) / len(doc) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, trans = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
    q = _quality(_scores(w, active), doc, length, len(label), trans)
    seen = ~np.isnan(q)
    x, t = _logit(q[seen]), label[seen]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, h = t - p, p * (1 - p) + 1e-6
        grad = np.array([(r * x).sum() - 0.1 * (a - 1), r.sum() - 0.1 * b])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, grad)
    return {"w": w, "trans": trans, "a": float(a), "b": float(b), "prior": prior}


def score_texts(model: dict, col: pa.Array, roll: RollingHash) -> np.ndarray:
    raw, at = flat(col)
    out = np.full(len(at) - 1, model["prior"])
    for lo, hi in steps(at):
        doc, length, active = line_features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], roll)
        q = _quality(_scores(model["w"], active), doc, length, hi - lo, model["trans"])
        s = 1 / (1 + np.exp(-(model["a"] * _logit(q) + model["b"])))
        out[lo:hi] = np.where(np.isnan(q), model["prior"], s)
    return out


def train_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> dict:
    """Fits on at most `limit` labelled rows whose crc32(id) mod 5 is not 0. Null labels and ids teach nothing."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents(docs).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, parts, labels = RollingHash(), [], []
        for batch in batches:
            raw, at = flat(batch[0])
            for lo, hi in steps(at):
                doc, length, active = line_features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], roll)
                parts.append((doc + sum(map(len, labels)), length, active))
                labels.append(np.asarray(batch[1].slice(lo, hi - lo)).astype(float))
        if parts:
            model = fit_lines(*(np.concatenate(x) for x in zip(*parts)), np.concatenate(labels))
            yield pa.RecordBatch.from_pylist([{"w": model["w"].tolist(), "trans": model["trans"].ravel().tolist(), "rest": [model[k] for k in ("a", "b", "prior")]}])
        trim()

    # The sample's size is bounded; one task fits it.
    fitted = rows.repartition(1).sortWithinPartitions("doc_id").select("text", "quality").mapInArrow(run, "w array<double>, trans array<double>, rest array<double>").collect()
    if not fitted:
        return fit([], [])
    a, b, prior = fitted[0].rest
    return {"w": np.array(fitted[0].w), "trans": np.array(fitted[0].trans).reshape(2, 2), "a": a, "b": b, "prior": prior}


def score_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the text, a row for each row of docs."""
    rows = documents(docs).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for batch in batches:
            score = score_texts(model, batch[1], roll)
            yield pa.RecordBatch.from_arrays([batch[0], batch[2], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        trim()

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def filter_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold."""
    names = [f.name for f in docs.schema.fields]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model, batch[at], roll) >= threshold))
        trim()

    # Numbered meanwhile, as names may have dots.
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return numbered.mapInArrow(run, numbered.schema).toDF(*names)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, null and empty texts too; repeated rows score alike, a null id is held out by neither fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
