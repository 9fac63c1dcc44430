"""LM scoring: a gated recurrent language model with a class-factored output, in numpy.

Tokens are white-space words (A-Z in lower case) and one end per text. Counts cover all training documents.
The vocabulary grows with the corpus: tokens above a small count (see least_count) have embeddings and, in about
sqrt(V) classes of like frequency (of a large vocabulary: in parts, classes of them and tokens, see Deep), output weights; all other tokens share one class, in which the add-one unigram model of the rare tokens (one share of it for unseen ones)
decides, so that the probabilities of all tokens sum to one. Training is truncated backpropagation through
windows of WINDOW steps with the state carried on, over all training documents, by trainers that grow in number
with the input and whose weights are averaged. Scoring carries the state over the whole document.

Null texts are empty texts: one end. Rows with a null id are scored, never learned from, and held out: null.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, documents, flat, lower, open_store, shared_dir, shuffles_end, slice_hashes, steps, trim, words, written

#: The vocabulary has so many tokens at least, if there are as many.
HEAD = 1024
#: A larger vocabulary than this has three levels of outputs, and classes of WIDTH / sqrt(share of all tokens) tokens.
FLAT, WIDTH = 1 << 14, 0.3
#: Numbers that tell a document's kind of words, by which its tokens are put into classes.
TRAITS = 4
HIDDEN = 24
WINDOW = 32
#: Lanes of a window in training, at most, and tokens that a lane has at least.
LANES, LONG = 1024, 2048
#: Lanes in scoring.
SCORE_LANES = 512
TRAINERS = 8
#: Tokens that one trainer takes, or as many as the model has numbers, if these are more; a larger input has more trainers.
TRAINER_TOKENS = 3_000_000
#: Weights travel to their average in pieces of so many numbers.
PIECE = 1 << 13
ROUNDS = 2
#: Rows whose outputs are worked on at once, forth and back, as they stay in a processor's cache; a class's rows stay together.
ROWS = 512
#: Rows whose outputs are made at once in scoring.
SCORED = 1 << 17
#: Numbers that the optimiser works on at once, for the same reason.
BLOCK = 1 << 15
#: The most frequent tokens, whose counts every task holds; counts of the others are joined.
FREQUENT = 100_000
END = 1
FOLDS, HELD_OUT = 7, 2


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit token hashes of all rows, each row's closed by END, and the rows' offsets; in small steps, as scans take tens of bytes a byte."""
    if len(at) > 2 and at[-1] > STEP_BYTES:
        ids, cuts = zip(*(tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in steps(at)))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c) for c in cuts]))])
    start, end, by_doc = words(raw, at)
    h = slice_hashes(lower(raw), start, end).view(np.int64)
    n = len(at) - 1
    out = np.empty(len(h) + n, np.int64)
    stops = by_doc[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[stops] = False
    out[mask], out[stops] = h, END
    return out, np.concatenate([[0], stops + 1])


def _held() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


def _learned() -> Column:
    return F.coalesce(~_held(), F.lit(False))


def least_count(n_all: int) -> int:
    """Tokens of this count are in the vocabulary: every token of a small corpus, 48 times in 23 million tokens."""
    return max(1, math.isqrt(n_all) // 100)


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c, t0, t1 and so on) of all tokens of the training documents: their counts and the sums of the traits of their documents."""
    more = [f"t{k}" for k in range(TRAITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = flat(b[0])
            for lo, hi in steps(at, 8 << 20):
                ids, cut = tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                order = np.argsort(ids)
                h = ids[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                sums = [np.add.reduceat(np.repeat(t, np.diff(cut))[order], first) for t in traits(ids, cut)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first], np.diff(first, append=len(h)), *sums)], ["h", "c", *more])
        trim()

    kind = ", ".join(f"{k} long" for k in ("h", "c", *more))
    return docs.where(_learned()).select("text").mapInArrow(run, kind).groupBy("h").agg(*(F.sum(k).alias(k) for k in ("c", *more)))


def traits(ids: np.ndarray, cut: np.ndarray) -> Iterator[np.ndarray]:
    """TRAITS numbers of each document: a thousand times the mean over its tokens of 1 or -1, as a bit of a token's hash says.

    Whole numbers, so that sums of them are the same in any order. Documents of one language have their frequent tokens in common, so their traits are alike."""
    mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(TRAITS):
        ones = np.add.reduceat((mixed >> np.uint64(63 - k)).astype(np.int64) & 1, cut[:-1])
        yield np.round(1000 * (2 * ones / np.diff(cut) - 1)).astype(np.int64)


class Model:
    """Weights and the vocabulary; tokens outside it have number HEAD (their class is the last)."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, rare_total: int, rare_types: int, seed: int = 7) -> None:
        order = np.argsort(head)
        self.sorted, self.number = head[order], order
        self.n = len(head)
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.w = {"E": small(self.n + 1, 3 * HIDDEN), "U": small(HIDDEN, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32), **self.outputs(counts, rare_total)}
        self.trained = 0  # tokens of the last round of training
        self.rare_log = float(np.log10(rare_total + rare_types + 1))

    def outputs(self, counts: np.ndarray, rare_total: int) -> dict[str, np.ndarray]:
        """Weights of the outputs, which give each token its share of the counts."""
        self.width = max(1, -(-self.n // max(1, math.isqrt(self.n))))
        self.classes = -(-self.n // self.width) if self.n else 0
        c = np.log(np.concatenate([counts, np.ones(self.classes * self.width - self.n)]) + 1e-300).reshape(self.classes, self.width) if self.n else np.zeros((0, 1))
        if self.n:
            c.reshape(-1)[self.n :] = -1e9
        mass = np.concatenate([np.exp(c).sum(1), [rare_total + 1.0]])
        return {"C": np.zeros((HIDDEN, self.classes + 1), np.float32), "cb": np.log(mass).astype(np.float32), "W": np.zeros((self.classes, HIDDEN, self.width), np.float32), "wb": (c - np.log(np.exp(c).sum(1, keepdims=True))).astype(np.float32)}

    def touched(self, y: np.ndarray) -> dict[str, np.ndarray]:
        """The rows of some weights that have gradients where y are the targets; of the others all have."""
        cls = np.unique(y[y < self.n] // self.width)
        return {"W": cls, "wb": cls}

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w.values()])

    def load(self, every: np.ndarray) -> None:
        cuts = np.cumsum([x.size for x in self.w.values()])[:-1]
        self.w = {k: part.reshape(x.shape).copy() for (k, x), part in zip(self.w.items(), np.split(every, cuts))}

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), self.n - 1)
        return np.where(self.sorted[at] == h, self.number[at], self.n)

    def run(self, x: np.ndarray, new: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States of a window. x, new: steps x lanes; new resets a lane's state before the step."""
        w, size, (steps, lanes) = self.w, HIDDEN, x.shape
        out = np.empty((steps, lanes, size), np.float32)
        before, cand = np.empty_like(out), np.empty_like(out)
        # Gates and candidate lie one after another, as operations on parts of rows are slow; the gates' sums are negated.
        # What is not kept for the way back is made step by step in small rooms, which stay in the cache.
        gates, hn = np.empty((steps, 2, lanes, size), np.float32), np.empty_like(out)
        by_state, inputs = np.empty((2, 3, lanes, size), np.float32)
        u = np.ascontiguousarray(w["U"].reshape(size, 3, size).transpose(1, 0, 2), np.float32)
        np.negative(u[:2], out=u[:2])
        bias = w["bias"].astype(np.float32).reshape(3, 1, size)
        resets = new.any(1)
        old = np.seterr(over="ignore")  # an infinite sum's gate is nought
        for t in range(steps):
            if resets[t]:
                state = np.where(new[t][:, None], np.float32(0), state)
            g, n, after = gates[t], cand[t], out[t]
            e = w["E"][x[t]].reshape(lanes, 3, size).transpose(1, 0, 2)
            np.add(e, bias, out=inputs, casting="same_kind")
            np.matmul(state, u, out=by_state)
            np.subtract(by_state[:2], inputs[:2], out=g)
            np.exp(g, out=g)
            g += np.float32(1)
            np.reciprocal(g, out=g)
            before[t] = state
            hn[t] = by_state[2]
            np.multiply(g[0], hn[t], out=n)
            n += inputs[2]
            # The hyperbolic tangent by the exponential, which takes half the time.
            n *= np.float32(2)
            np.exp(n, out=n)
            n += np.float32(1)
            np.divide(np.float32(-2), n, out=n)
            n += np.float32(1)
            np.subtract(state, n, out=after)
            after *= g[1]
            after += n
            state = after
        np.seterr(**old)
        return out, (before, gates, cand, hn)

    def output(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of y given states h (rows); with grad also the gradient to h (of scale-weighted log loss).

        grad then holds the gradients of C, cb and, for the classes of y, W and wb. Rows are dealt to their classes by
        sorting, so that only the products are made class by class."""
        w, n = self.w, len(h)
        cls = np.where(y < self.n, y // self.width, self.classes)
        order = np.argsort(cls.astype(np.min_scalar_type(self.classes)), kind="stable")
        order = order[: np.searchsorted(cls[order], self.classes)]  # without rare tokens
        mine = cls[order]
        inside = y[order] - mine * self.width
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        ends = [*first[1:].tolist(), len(mine)]
        groups = list(zip(mine[first].tolist(), first.tolist(), ends))
        # A column of ones beside the states makes the classes' bias and its gradient part of the products.
        kind = np.result_type(h, w["W"])
        one, both, ct = np.ones((n, HIDDEN + 1), kind), np.concatenate([w["C"], w["cb"][None]]), w["C"].T
        one[:, :HIDDEN] = h
        hs = h[order]
        logp, dh = np.empty(n, kind), None
        if grad is not None:
            scale, dh, total = scale.astype(kind), np.empty(h.shape, kind), np.zeros_like(both)
            scales, back = scale[order], np.empty(hs.shape, kind)
        for lo in range(0, n, ROWS):
            part = slice(lo, min(lo + ROWS, n))
            logp[part], e, size = _softmax(lambda: one[part] @ both, cls[part], grad is not None)
            if grad is not None:
                # Sums go by the rows as they are: sorted ones let large sums of one sign build up, whose rounding spoils the training.
                by = (scale[part] / size)[:, None]
                total += (one[part] * by).T @ e
                np.multiply(e @ ct, by, out=dh[part])
        if grad is not None:
            grad["C"][...], grad["cb"][...] = total[:-1], total[-1]
        at = 0
        while at < len(groups):
            start = groups[at][1]
            to = max(at + 1, bisect.bisect_right(ends, start + ROWS))
            some, stop = groups[at:to], ends[to - 1]
            at = to

            def by_token() -> np.ndarray:
                z = np.empty((stop - start, self.width), kind)
                for c, a, b in some:
                    mine = z[a - start : b - start]
                    np.dot(hs[a:b], w["W"][c], out=mine)
                    mine += w["wb"][c]
                return z

            more, e, size = _softmax(by_token, inside[start:stop], grad is not None)
            logp[order[start:stop]] += more
            if grad is not None:
                by = scales[start:stop] / size
                hb = hs[start:stop] * by[:, None]
                for c, a, b in some:
                    mine = e[a - start : b - start]
                    np.dot(hb[a - start : b - start].T, mine, out=grad["W"][c])
                    np.dot(by[a - start : b - start], mine, out=grad["wb"][c])
                    np.dot(mine, w["W"][c].T, out=back[a:b])
                back[start:stop] *= by[:, None]
        if grad is not None:
            dh[order] += back
        return logp, dh

    def backward(self, x: np.ndarray, new: np.ndarray, kept: tuple, dout: np.ndarray, grad: dict) -> np.ndarray:
        """grad gets the gradients of U, bias and, for the tokens of x, which are returned, of E."""
        w, size = self.w, HIDDEN
        before, gates, cand, hn = kept
        carry, ut, one = np.zeros_like(before[0]), np.ascontiguousarray(w["U"].T), np.float32(1)
        dx, dn = np.empty((*x.shape, 3 * size), np.float32), np.empty_like(before)
        resets, room, by_h = new.any(1), np.empty_like(before[0]), np.empty_like(before[0])
        for t in range(len(x) - 1, -1, -1):
            # All of a step's numbers stay in the cache.
            dh, du, dc, (r, z), c = dout[t] + carry, dx[t], dn[t], gates[t], cand[t]
            np.subtract(one, z, out=by_h)
            by_h *= dh
            np.multiply(c, c, out=room)
            np.subtract(one, room, out=room)
            np.multiply(by_h, room, out=dc)
            np.subtract(before[t], c, out=room)
            room *= z
            np.multiply(by_h, room, out=du[:, size : 2 * size])
            np.subtract(one, r, out=room)
            room *= r
            room *= hn[t]
            np.multiply(dc, room, out=du[:, :size])
            np.multiply(dc, r, out=du[:, 2 * size :])
            dh *= z
            dh += du @ ut
            carry = np.where(new[t][:, None], np.float32(0), dh) if resets[t] else dh
        dx = dx.reshape(-1, 3 * size)
        grad["U"][...] = before.reshape(-1, size).T @ dx
        dx[:, 2 * size :] = dn.reshape(-1, size)
        dx.sum(0, out=grad["bias"])
        number = x.ravel().astype(np.min_scalar_type(self.n))
        order = np.argsort(number, kind="stable" if number.itemsize < 4 else None)
        number = number[order]
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        which = number[first].astype(np.int64)
        # Two numbers at a time, which a complex one holds: reduceat adds one after another.
        grad["E"][which] = np.add.reduceat(dx[order].view(np.complex64), first).view(np.float32)
        return which


class Deep(Model):
    """The model of a large vocabulary, whose outputs are a tree of three levels: parts, their classes, a class's tokens.

    Classes hold tokens of like frequency, and the rarer these are, the wider they are: a class costs calls in each
    window, and its width work for each of its occurrences, which both are least at widths by the inverse root of
    frequency. Classes of one width are a layer (W0, W1 and so on, the last row of a class's weights being its bias),
    in which tokens of like documents, such as those of one language, lie together, so that the choice of a part and a
    class tells much of them. Tokens outside the vocabulary are the last part."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, rare_total: int, rare_types: int, traits: np.ndarray, seed: int = 7) -> None:
        """head by falling count; traits: a row of numbers for each token, alike for those of like documents."""
        share = np.maximum(counts, 1.0) / (counts.sum() + rare_total + 1.0)
        width = 2 ** np.maximum(np.round(np.log2(WIDTH / np.sqrt(share))), 3).astype(np.int64)
        ends = np.flatnonzero(np.diff(width, append=0)) + 1
        self.spans = [(lo, hi, int(width[lo])) for lo, hi in zip([0, *ends.tolist()], ends.tolist())]
        order = np.concatenate([x for lo, hi, size in self.spans for x in _alike(traits, np.arange(lo, hi), size)])
        super().__init__(head[order], counts[order], rare_total, rare_types, seed)

    def outputs(self, counts: np.ndarray, rare_total: int) -> dict[str, np.ndarray]:
        self.layers, self.first, w, masses = [], [], {}, []
        for k, (lo, hi, size) in enumerate(self.spans):
            n = -(-(hi - lo) // size)
            c = np.zeros(n * size)
            c[: hi - lo] = counts[lo:hi]
            self.layers.append((f"W{k}", sum(map(len, self.first))))
            self.first.append(lo + size * np.arange(n))
            masses.append(c.reshape(n, size).sum(1))
            w[f"W{k}"] = _level_weights(c.reshape(n, size))
        self.first, mass = np.concatenate(self.first), np.concatenate(masses)
        self.classes = len(mass)
        #: The class of each token; those outside the vocabulary have the last number.
        self.cls = np.append(np.searchsorted(self.first, np.arange(self.n), "right") - 1, self.classes).astype(np.int32)
        self.each = math.isqrt(self.classes - 1) + 1
        self.parts = -(-self.classes // self.each)
        mass = np.append(mass, np.zeros(self.parts * self.each - self.classes)).reshape(self.parts, self.each)
        return {"root": _level_weights(np.append(mass.sum(1), rare_total + 1.0)[None]), "part": _level_weights(mass), **w}

    def touched(self, y: np.ndarray) -> dict[str, np.ndarray]:
        there = np.bincount(self.cls[y], minlength=self.classes + 1) > 0
        return {k: np.flatnonzero(there[lo : lo + len(self.w[k])]) for k, lo in self.layers}

    def output(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        cls = self.cls[y]
        order = np.argsort(cls.astype(np.min_scalar_type(self.classes)), kind="stable")
        order = order[: len(order) - int((cls == self.classes).sum())]  # without rare tokens
        mine = cls[order]
        one = np.ones((len(h), HIDDEN + 1), np.result_type(h, self.w["root"]))
        one[:, :HIDDEN] = h
        dh = back = scales = None
        if grad is not None:
            dh, back = np.zeros(h.shape, one.dtype), np.zeros((len(mine), HIDDEN), one.dtype)
            scale = scale.astype(one.dtype)
            scales = scale[order]
        level = lambda k, *rows: _level(*rows, self.w[k], None if grad is None else grad[k])
        logp = level("root", one, np.zeros(len(h), np.int64), np.where(cls < self.classes, cls // self.each, self.parts), scale, dh)
        hs, at = one[order], mine // self.each
        more = level("part", hs, at, mine - at * self.each, scales, back)
        inside = y[order] - self.first[mine]
        cuts = np.searchsorted(mine, [lo for _, lo in self.layers] + [self.classes]).tolist()
        for (k, lo), a, b in zip(self.layers, cuts, cuts[1:]):
            if a < b:
                more[a:b] += level(k, hs[a:b], mine[a:b] - lo, inside[a:b], None if grad is None else scales[a:b], None if grad is None else back[a:b])
        logp[order] += more
        if grad is not None:
            dh[order] += back
        return logp, dh


def _alike(traits: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """rows in classes of size, the last one smaller: halved, again and again, across the direction in which their traits differ most."""
    if len(rows) <= size:
        return [rows]
    x = traits[rows] - traits[rows].mean(0)
    rows = rows[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
    half = -(-len(rows) // size) // 2 * size
    return [*_alike(traits, rows[:half], size), *_alike(traits, rows[half:], size)]


def _level_weights(counts: np.ndarray) -> np.ndarray:
    """Weights of nodes with these counts below them, whose last row, the bias, gives every one its share; none: no share."""
    w = np.zeros((len(counts), HIDDEN + 1, counts.shape[1]), np.float32)
    with np.errstate(divide="ignore"):
        w[:, HIDDEN] = np.maximum(np.log(counts / counts.sum(1, keepdims=True)), -1e9)
    return w


def _level(h: np.ndarray, node: np.ndarray, child: np.ndarray, scale: np.ndarray | None, back: np.ndarray | None, w: np.ndarray, grad: np.ndarray | None) -> np.ndarray:
    """Log probabilities of the children of rows' nodes, which are sorted; with grad also the nodes' gradients, set, and the rows', which back gets more."""
    n, width = len(h), w.shape[2]
    most, logp = max(ROWS // 4, BLOCK // width), np.empty(n, h.dtype)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    pieces = [(c, lo, min(lo + most, b), lo == a) for c, a, b in zip(node[first].tolist(), first.tolist(), [*first[1:].tolist(), n]) for lo in range(a, b, most)]
    ends, at = [b for _, _, b, _ in pieces], 0
    while at < len(pieces):
        start = pieces[at][1]
        to = max(at + 1, bisect.bisect_right(ends, start + most))
        some, stop = pieces[at:to], ends[to - 1]
        at = to

        def logits() -> np.ndarray:
            z = np.empty((stop - start, width), h.dtype)
            for c, a, b, _ in some:
                np.dot(h[a:b], w[c], out=z[a - start : b - start])
            return z

        logp[start:stop], e, size = _softmax(logits, child[start:stop], grad is not None)
        if grad is not None:
            by = (scale[start:stop] / size)[:, None]
            hb, db = h[start:stop] * by, np.empty((stop - start, HIDDEN), h.dtype)
            for c, a, b, new in some:
                a, b = a - start, b - start
                if new:
                    np.dot(hb[a:b].T, e[a:b], out=grad[c])
                else:
                    grad[c] += hb[a:b].T @ e[a:b]
                np.dot(e[a:b], w[c, :HIDDEN].T, out=db[a:b])
            db *= by
            back[start:stop] += db
    return logp


def _softmax(logits: Callable[[], np.ndarray], target: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of the targets, the exponentials and their sums; with slope the sum is taken off the target's,
    so that a row divided by its sum is the gradient of log loss to the logits.

    Rows are shifted by their maximum only if a sum would leave the middle of the numbers' range."""
    rows = np.arange(len(target))
    for shift in (False, True):
        e = logits()
        if shift:
            e -= e.max(1, keepdims=True)
        logp = e[rows, target]
        with np.errstate(over="ignore"):
            np.exp(e, out=e)
            total = e @ np.ones(e.shape[1], e.dtype)
        if not len(total) or (total.min() > 1e-25 and total.max() < 1e25):
            break
    logp -= np.log(total)
    if slope:
        e[rows, target] -= total
    return logp, e, total


def _lanes(n_tokens: np.ndarray, n_lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, each to the lane with least so far; lanes by falling length."""
    import heapq

    heap = [(0, k) for k in range(max(1, min(n_lanes, len(n_tokens))))]
    lanes: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-n_tokens, kind="stable").tolist():
        total, k = heapq.heappop(heap)
        lanes[k].append(i)
        heapq.heappush(heap, (total + int(n_tokens[i]), k))
    return sorted(lanes, key=lambda ds: -sum(int(n_tokens[i]) for i in ds))


def _even_lanes(at: np.ndarray, n_lanes: int) -> int:
    """So few that a small input makes some steps too, however long its documents are."""
    return max(1, min(n_lanes, int(at[-1]) // LONG))


def _windows(ids: np.ndarray, at: np.ndarray, n_lanes: int, end: int, even: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Input numbers, resets, targets and places of each window of the active lanes; all documents, one after another.

    Even lanes are equal parts of the row of all documents, so that no windows of a few lanes are left over at the end;
    a document that two lanes share goes on in the second without the state, but after its last token."""
    sizes = np.diff(at)
    first = np.zeros(len(ids), bool)
    first[at[:-1]] = True
    fresh = first
    if even:
        place = np.array_split(np.arange(len(ids)), _even_lanes(at, n_lanes))
        total = np.array([len(p) for p in place])
        fresh = first.copy()
        fresh[[p[0] for p in place if len(p)]] = True
    else:
        lanes = _lanes(sizes, n_lanes)
        total = np.array([sum(int(sizes[i]) for i in ds) for ds in lanes])
        place = [np.concatenate([np.arange(at[i], at[i + 1]) for i in ds]) if ds else np.zeros(0, np.int64) for ds in lanes]
    for t in range(0, int(total.max()) if len(total) else 0, WINDOW):
        active = int((total > t).sum())
        span = min(WINDOW, int(total[0]) - t)
        where = np.full((span, active), -1, np.int64)
        for k in range(active):
            part = place[k][t : t + span]
            where[: len(part), k] = part
        there = where >= 0
        at0 = np.where(there, where, 0)
        x = np.where(first[at0], end, ids[np.maximum(at0 - 1, 0)])
        yield np.where(there, x, end), fresh[at0] & there, np.where(there, ids[at0], end), where, active


def log_probabilities(model: Model, h: np.ndarray, at: np.ndarray, n_lanes: int = SCORE_LANES, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability (of its class alone for rare tokens), and which tokens are rare; ids: their numbers, if known."""
    ids = model.numbers(h) if ids is None else ids
    end = int(model.numbers(np.array([END]))[0])
    out = np.zeros(len(ids))
    state = np.zeros((n_lanes, HIDDEN), np.float32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        """The outputs of many windows at once, as a class's calls cost the same for few rows as for many."""
        if held:
            states, y, where = map(np.concatenate, zip(*held))
            out[where] = model.output(states, y)[0]
            held.clear()

    for x, new, y, where, active in _windows(ids, at, n_lanes, end):
        states, _ = model.run(x, new, state[:active])
        state = states[-1]
        there = where >= 0
        held.append((states[there], y[there], where[there]))
        if sum(len(y) for _, y, _ in held) >= SCORED:
            settle()
    settle()
    return out / np.log(10), ids == model.n


class Adam:
    """The optimiser's moments, kept from slice to slice, as sums: ten times the mean gradient, a thousand times the mean square."""

    def __init__(self, model: Model) -> None:
        self.m, self.v, self.grad = ({k: np.zeros_like(x) for k, x in model.w.items()} for _ in range(3))
        self.step, self.rows, self.room = 0, 1.0, np.empty(BLOCK, np.float32)

    def update(self, model: Model, touched: dict[str, np.ndarray], rate: float) -> None:
        """A step for the touched rows of some weights and for all of the others; gradients are cut to a norm of 1."""
        self.step += 1
        parts = [(k, s) for k in model.w for s in ([touched[k]] if k == "E" else _blocks(touched[k], model.w[k][0].size) if k in touched else [slice(None)])]
        grads = [self.grad[k][s] for k, s in parts]
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        size = math.sqrt(0.001 / (1 - 0.999**self.step))
        pace, least = np.float32(rate * 0.1 / (1 - 0.9**self.step) / size), np.float32(1e-6 / size)
        for (k, s), g in zip(parts, grads):
            if norm > 1:
                g *= np.float32(1 / (norm + 1e-9))
            m, v = self.m[k][s], self.v[k][s]
            m *= np.float32(0.9)
            m += g
            v *= np.float32(0.999)
            # The steps are made in a small room, which stays in the cache, as large gradients go to memory and back.
            room = self.room[: g.size].reshape(g.shape) if g.size <= BLOCK else np.empty_like(g)
            np.multiply(g, g, out=room)
            v += room
            if k == "E":  # these rows are copies
                self.m[k][s], self.v[k][s] = m, v
            np.sqrt(v, out=room)
            room += least
            np.divide(m, room, out=room)
            room *= pace
            model.w[k][s] -= room


def _blocks(rows: np.ndarray, width: int) -> Iterator[slice]:
    """Sorted row numbers as slices, of as many numbers at most as a processor's cache holds with their moments."""
    most, ends = max(1, BLOCK // width), np.flatnonzero(np.diff(rows) != 1) + 1
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(rows)]):
        for lo in range(a, b, most):
            yield slice(int(rows[lo]), int(rows[min(lo + most, b) - 1]) + 1)


def train(model: Model, h: np.ndarray, at: np.ndarray, adam: Adam | None = None, rate: float = 0.01, n_lanes: int = LANES) -> int:
    """One pass of truncated backpropagation with Adam; returns the number of tokens.

    Of E only the rows of input tokens, and of W and wb only the classes of targets get gradients in a window, and
    only these are updated. Every token weighs the same, in short windows too; rate holds for windows of up to 57 lanes and
    grows with the root of their number."""
    ids = model.numbers(h)
    rate *= max(1.0, 1.5 * math.sqrt(_even_lanes(at, n_lanes) / 128))
    end = int(model.numbers(np.array([END]))[0])
    adam = adam or Adam(model)
    state = np.zeros((n_lanes, HIDDEN), np.float32)
    for x, new, y, where, active in _windows(ids, at, n_lanes, end, even=True):
        states, kept = model.run(x, new, state[:active])
        state = states[-1]
        there = (where.ravel() >= 0).astype(np.float32)
        adam.rows = max(adam.rows, float(there.sum()))
        _, dh = model.output(states.reshape(-1, HIDDEN), y.ravel(), adam.grad, there / adam.rows)
        which = model.backward(x, new, kept, dh.reshape(states.shape), adam.grad)
        adam.update(model, {"E": which, **model.touched(y.ravel())}, rate)
    return len(ids)


def _store(spark: SparkSession, thing: object) -> str:
    """thing in shared storage, once: what a function carries along is copied to the disks of the driver and of all executors."""
    uri = shared_dir(spark, "model")
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0])
    with store.open_output_stream(path) as out:
        out.write(pickle.dumps(thing, pickle.HIGHEST_PROTOCOL))
    return uri


def _fetch(uri: str) -> object:
    store, path = open_store(uri)
    with store.open_input_stream(path) as f:
        return pickle.loads(f.read())


def trainers_for(n_tokens: int, numbers: int, least: int = TRAINERS) -> int:
    """So few that the weights they send, which are of the model's size each, stay in proportion to the tokens."""
    return max(least, -(-n_tokens // max(TRAINER_TOKENS, numbers)))


def fit(docs: DataFrame, counts: DataFrame, trainers: int = TRAINERS, rounds: int = ROUNDS) -> tuple[Model, np.ndarray, np.ndarray, int, int]:
    """The model, the frequent tokens with their counts (by falling count), all training tokens N and types V."""
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The vocabulary's counts are held by every task too, as its tokens are no part of the join.
    size = max(HEAD, counts.where(F.col("c") >= least_count(int(n_all))).count())
    top = counts.orderBy(F.desc("c"), "h").limit(max(FREQUENT, size)).toArrow()
    h, c = np.asarray(top["h"].combine_chunks()).astype(np.int64), np.asarray(top["c"].combine_chunks()).astype(np.int64)
    head = h[:size]
    known = head, c[:size].astype(float), int(n_all - c[:size].sum()), int(v_all - len(head))
    if len(head) > FLAT:
        sums = np.stack([np.asarray(top[f"t{k}"].combine_chunks())[:size] for k in range(TRAITS)], 1)
        model = Deep(*known, sums / known[1][:, None])
    else:
        model = Model(*known)
    # Dealt by id and text, so that the copies of one text are spread.
    dealt = docs.where(_learned()).select("text", F.xxhash64("doc_id", "text").alias("k"))
    trainers = trainers_for(int(n_all), sum(x.size for x in model.w.values()), trainers)

    def trainer(stored: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, model = 0, _fetch(stored)
            adam = Adam(model)
            for b in batches:
                raw, at = flat(b[0])
                for lo, hi in steps(at, 8 << 20):
                    ids, cut = tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    total += train(model, ids, cut, adam)
            every = model.vector()
            del model, adam
            for k, lo in enumerate(range(0, len(every) if total else 0, PIECE)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total]), pa.array([every[lo : lo + PIECE].tobytes()], pa.binary())], ["k", "n", "w"])
            del every
            trim()

        return one

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, w in zip(*(c.to_pylist() for c in b.columns)):
                held = sums.setdefault(k, [0, 0.0])
                held[0] += n
                held[1] = held[1] + n * np.frombuffer(w, np.float32).astype(np.float64)
        for k, (n, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n]), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())], ["k", "n", "w"])

    kind = "k long, n long, w binary"
    for _ in range(rounds if len(head) else 0):
        stored = _store(docs.sparkSession, model)
        # One set of weights comes back, however many trainers there are.
        with shuffles_end(docs.sparkSession):
            parts = dealt.repartitionById(trainers, F.pmod("k", F.lit(trainers)).cast("int")).sortWithinPartitions("k").select("text").mapInArrow(trainer(stored), kind)
            parts = sorted(parts.repartition("k").mapInArrow(mean, kind).collect(), key=lambda r: r.k)
        store, path = open_store(stored)
        store.delete_file(path)
        if parts:
            model.trained = parts[0].n
            model.load(np.concatenate([np.frombuffer(r.w, np.float32) for r in parts]))
    return model, h, c, int(n_all), int(v_all)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    rows = documents(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = written(token_counts(rows), "counts")
    model, top, top_c, n_all, v_all = fit(rows, counts)
    order = np.argsort(top)
    # The vocabulary is part of the frequent tokens, so one search finds a token's number and count.
    stored = _store(docs.sparkSession, (model, top[order], np.log10(top_c[order] + 1.0), model.numbers(top[order])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        model, top, log_c, number = _fetch(stored)
        for b in batches:
            raw, at = flat(b[1])
            for lo, hi in steps(at, 8 << 20):
                ids, cut = tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                place = np.minimum(np.searchsorted(top, ids), max(0, len(top) - 1))
                local = top[place] == ids if len(top) else np.zeros(len(ids), bool)
                logp, rare = log_probabilities(model, ids, cut, ids=np.where(local, number[place], model.n) if len(top) else None)
                base = np.where(local, log_c[place] if len(top) else 0.0, 0.0)
                logp = logp + np.where(rare, np.where(local, base, 0.0) - model.rare_log, 0.0)
                first, n = cut[:-1], np.diff(cut)
                rest = np.concatenate([[0], np.cumsum(~local)])[cut].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(serial + np.arange(hi - lo)), b[0].slice(lo, hi - lo), b[2].slice(lo, hi - lo), pa.array(n),
                     pa.array(np.add.reduceat(local.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logp, first)), pa.ListArray.from_arrays(pa.array(rest), pa.array(ids[~local]))],
                    ["key", "doc_id", "held_out", "n_tokens", "known", "base", "part", "rest"],
                )
                serial += hi - lo
        trim()

    seen = written(rows.withColumn("held_out", _held()).mapInArrow(run, f"key long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, part double, rest array<long>"), "scores")
    rest = seen.select("key", F.explode("rest").alias("h")).groupBy("key", "h").agg(F.count("*").alias("n")).join(counts.select("h", "c"), "h")
    more = rest.groupBy("key").agg(F.sum("n").alias("k2"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("b2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return seen.drop("rest").join(more, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("k2")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b2") - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))).alias("base_score"), (F.col("part") + zero("b2")).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See score_documents: a row for each document, a null text being one end; null ids are scored, never learned from."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
