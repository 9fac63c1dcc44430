import collections
import math
import sys
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq

from langlens.llm import recurrent

from .docs import BASE, empty, frame


def brute(rows):
    c = collections.Counter()
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if held(i) is False:
            c.update(toks(t))
    n, v = sum(c.values()), len(c)
    return {(i, t): (held(i), len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(t))) for i, t in rows}


def check(got, rows):
    want = sorted(((i, *x) for (i, _), x in brute(rows).items()), key=str)
    seen = sorted({(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score): r for r in got}, key=str)
    assert len(seen) == len(want)
    for a, b in zip(sorted(seen, key=lambda x: (str(x[0]), x[2])), sorted(want, key=lambda x: (str(x[0]), x[2]))):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_counts_and_base(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "FREQUENT", 3)
    got = recurrent.score_documents(frame(spark)).collect()
    assert len(got) == len(BASE)
    check(got, BASE)
    assert recurrent.score_documents(empty(spark)).collect() == []


def test_probabilities_sum_to_one():
    head = np.arange(10, 50)
    model = recurrent.Model(head, np.arange(40, 0, -1.0), 30, 9)
    model.w["C"] += np.random.default_rng(1).normal(0, 1, model.w["C"].shape).astype(np.float32)
    h = np.random.default_rng(2).normal(0, 1, (1, recurrent.HIDDEN)).astype(np.float32)
    total = sum(float(np.exp(model.output(h, np.array([y]))[0][0])) for y in range(model.n + 1))
    assert abs(total - 1) < 1e-4


def test_gradient():
    rng = np.random.default_rng(3)
    model = recurrent.Model(np.arange(10, 30), np.ones(20), 5, 5)
    for k in model.w:
        if k != "wb":
            model.w[k] = rng.normal(0, 0.3, model.w[k].shape)
    x, y = rng.integers(0, 21, (4, 3)), rng.integers(0, 21, 12)
    new = rng.random((4, 3)) < 0.3

    def loss():
        return -model.output(model.run(x, new, np.zeros((3, recurrent.HIDDEN)))[0].reshape(12, -1).astype(float), y)[0].sum()

    grad = {k: np.zeros(v.shape) for k, v in model.w.items()}
    states, kept = model.run(x, new, np.zeros((3, recurrent.HIDDEN)))
    _, dh = model.output(states.reshape(12, -1).astype(float), y, grad, np.ones(12))
    model.backward(x, new, kept, dh.reshape(states.shape), grad)
    for k in ("E", "U", "bias", "C", "W"):
        i = np.unravel_index(np.argmax(abs(grad[k])), grad[k].shape)
        model.w[k][i] += 1e-3
        up = loss()
        model.w[k][i] -= 2e-3
        down = loss()
        model.w[k][i] += 1e-3
        assert abs((up - down) / 2e-3 - grad[k][i]) < 0.02 * abs(grad[k][i]) + 1e-3, k


def test_beats_the_unigram_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = recurrent.score_documents(df).collect()
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    check(got, [(r["doc_id"], r["text"]) for r in rows])
    held = [r for r in got if r.held_out]
    print("score, base", sum(r.score for r in held) / sum(r.n_tokens for r in held), sum(r.base_score for r in held) / sum(r.n_tokens for r in held))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_training_document_gives_gradients(spark):
    rows = [(i, f"word{i % 3} and more") for i in range(40)] + [(100 + i, "one hot text") for i in range(20)]
    docs = frame(spark, rows)
    model, _, _, n_all, _ = recurrent.fit(docs, recurrent.token_counts(docs))
    assert model.trained == n_all > 0
    for i in range(3):  # whatever the one text of a table is, it is learned from
        docs = frame(spark, [(k, f"lone text {i}") for k in range(10)])
        model, _, _, n_all, _ = recurrent.fit(docs, recurrent.token_counts(docs), rounds=1)
        assert model.trained == n_all and np.any(model.w["C"])


def test_vocabulary_grows_with_the_corpus(spark):
    sizes = []
    for n in (500, 3000):
        docs = frame(spark, [(i, f"w{i} w{i} common") for i in range(n)])
        model, *_ = recurrent.fit(docs, recurrent.token_counts(docs), rounds=0)
        sizes.append(model.n)
        assert 0.5 * model.n**0.5 < model.classes < 2 * model.n**0.5
    assert sizes[0] < 1024 < 2 * 1024 < sizes[1]


def test_rare_tokens_are_joined(spark, monkeypatch):
    for name, value in (("HEAD", 2), ("FREQUENT", 3), ("least_count", lambda n: n)):
        monkeypatch.setattr(recurrent, name, value)
    check(recurrent.score_documents(frame(spark)).collect(), BASE)


def test_scores_equal_a_plain_version():
    rng = np.random.default_rng(4)
    head = np.array([recurrent.END, *range(10, 40)])
    model = recurrent.Model(head, np.arange(len(head), 0, -1.0), 30, 9)
    for k in model.w:
        if k != "wb":
            model.w[k] = model.w[k] + rng.normal(0, 0.4, model.w[k].shape).astype(np.float32)
    docs = [[*rng.integers(8, 44, n).tolist(), recurrent.END] for n in (0, 1, 70, 5, 33, 31, 32)]
    at = np.cumsum([0, *map(len, docs)])
    got, rare = recurrent.log_probabilities(model, np.concatenate(docs).astype(np.int64), at, n_lanes=3)
    w, size, want = model.w, recurrent.HIDDEN, []
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    soft = lambda z: z - np.log(np.exp(z).sum())
    number = {int(t): i for i, t in enumerate(head)}
    for d in docs:
        state, last = np.zeros(size), number[recurrent.END]
        for t in d:
            x, u = w["E"][last] + w["bias"], state @ w["U"]
            r, z = sigmoid(x[:size] + u[:size]), sigmoid(x[size : 2 * size] + u[size : 2 * size])
            n = np.tanh(x[2 * size :] + r * u[2 * size :])
            state = (1 - z) * n + z * state
            last = number.get(t, model.n)
            c = min(last // model.width, model.classes) if last < model.n else model.classes
            p = soft(state @ w["C"] + w["cb"])[c]
            if last < model.n:
                p += soft(state @ w["W"][c] + w["wb"][c])[last - c * model.width]
            want.append(p / np.log(10))
    assert np.allclose(got, want, atol=1e-4)
    assert rare.tolist() == [t not in number for d in docs for t in d]


def test_few_calls_for_each_class():
    n, rng, calls = 2500, np.random.default_rng(5), []
    model = recurrent.Model(np.arange(10, 10 + n), np.ones(n), 5, 5)
    h, y = rng.normal(0, 0.3, (n, recurrent.HIDDEN)).astype(np.float32), rng.permutation(n)
    grad, scale = {k: np.zeros_like(v) for k, v in model.w.items()}, np.full(n, 1 / n, np.float32)
    sys.setprofile(lambda frame, event, what: calls.append(what) if event == "c_call" else None)
    try:
        model.output(h, y, grad, scale)
    finally:
        sys.setprofile(None)
    print(len(calls) / model.classes)
    assert len(calls) < 6 * model.classes  # a window's time had gone into calls on a few rows each


def test_outputs_in_blocks_equal_a_plain_version():
    n, v, rng = 6000, 40_000, np.random.default_rng(9)
    model = recurrent.Model(np.arange(10, 10 + v), np.arange(v, 0, -1.0), 50, 5)
    model.w["C"] += rng.normal(0, 0.3, model.w["C"].shape).astype(np.float32)
    model.w["W"] += rng.normal(0, 0.3, model.w["W"].shape).astype(np.float32)
    h, scale = rng.normal(0, 0.5, (n, recurrent.HIDDEN)).astype(np.float32), rng.random(n).astype(np.float32)
    y = np.where(rng.random(n) < 0.3, rng.integers(0, 100, n), rng.integers(0, v + 1, n))  # one class has over 1,700 rows
    y[:5] = v
    grad = {k: np.zeros_like(x) for k, x in model.w.items()}
    tracemalloc.start()
    logp, dh = model.output(h, y, grad, scale)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(peak / (n * model.width * 4))
    assert peak < 1.5 * n * model.width * 4  # not all rows' outputs at once, which don't stay in a processor's cache
    w, h = {k: x.astype(float) for k, x in model.w.items()}, h.astype(float)
    want = {k: np.zeros(x.shape) for k, x in w.items()}
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    for i, t in enumerate(y.tolist()):
        c = min(t // model.width, model.classes) if t < model.n else model.classes
        p = soft(h[i] @ w["C"] + w["cb"])
        d, lp = scale[i] * (p - (np.arange(len(p)) == c)), np.log(p[c])
        want["C"] += np.outer(h[i], d)
        want["cb"] += d
        back = w["C"] @ d
        if t < model.n:
            p = soft(h[i] @ w["W"][c] + w["wb"][c])
            d = scale[i] * (p - (np.arange(model.width) == t - c * model.width))
            lp += np.log(p[t - c * model.width])
            want["W"][c] += np.outer(h[i], d)
            want["wb"][c] += d
            back = back + w["W"][c] @ d
        assert abs(lp - logp[i]) < 1e-4 and np.allclose(back, dh[i], atol=1e-4)
    assert all(np.allclose(grad[k], want[k], atol=2e-3) for k in ("C", "cb", "W", "wb"))


def test_logits_beyond_the_range_of_exp():
    rng = np.random.default_rng(6)
    model = recurrent.Model(np.arange(10, 40), np.ones(30), 5, 5)
    h, y = rng.normal(0, 0.5, (50, recurrent.HIDDEN)).astype(np.float32), rng.integers(0, 31, 50)
    y[:30] = np.arange(30)
    model.w["W"] = rng.normal(0, 0.3, model.w["W"].shape).astype(np.float32)
    got = []
    for shift in (0, 300, -300):  # added to all logits, which changes no probability
        model.w["cb"], model.w["wb"] = model.w["cb"] + np.float32(shift), model.w["wb"] + np.float32(shift)
        grad = {k: np.zeros_like(v) for k, v in model.w.items()}
        got.append((*model.output(h, y, grad, np.ones(50, np.float32)), grad["C"], grad["W"], grad["wb"]))
    for more in got[1:]:
        assert all(np.all(np.isfinite(b)) and np.allclose(a, b, atol=2e-3) for a, b in zip(got[0], more))


def test_rounds_leave_no_shuffle_files(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    docs = frame(spark, [(i, f"w{i} w{i * 7 % 900} common") for i in range(3000)])
    counts = recurrent.token_counts(docs).cache()
    counts.count()
    before = held()
    model, *_ = recurrent.fit(docs, counts, rounds=1)
    sent = recurrent.TRAINERS * model.vector().nbytes
    for _ in range(50):  # files go in the background
        if held() - before < sent / 10:
            break
        time.sleep(0.2)
    assert held() - before < sent / 10


def test_weights_sent_stay_in_proportion():
    assert recurrent.trainers_for(20_000_000, 4_000_000) == recurrent.TRAINERS
    for n, numbers in ((10**8, 8 * 10**6), (10**9, 25 * 10**6), (10**10, 80 * 10**6)):
        k = recurrent.trainers_for(n, numbers)
        assert k * numbers < 1.2 * n and k * max(numbers, recurrent.TRAINER_TOKENS) >= n


def test_functions_carry_no_weights(spark, monkeypatch):
    docs, sizes, broadcast = frame(spark, [(i, f"w{i} w{i} common") for i in range(4000)]), [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sizes.append(len(value)) or broadcast(self, value))
    got = recurrent.score_documents(docs)  # functions of more than a megabyte are broadcast, by way of all disks
    assert got.count() == 4000 and sum(sizes) == 0


def test_tokens_in_small_steps():
    rng = np.random.default_rng(8)
    texts = [b" ".join(b"Word%d" % i for i in rng.integers(0, 900, n)) for n in (3000, 0, 1, 40000, 7, 90000, 250000, 0, 5)]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    tracemalloc.start()
    ids, cut = recurrent.tokens(raw, at)
    small = np.concatenate([np.tile(np.frombuffer(b"a b ", np.uint8), 2000)] * 1500)
    tracemalloc.reset_peak()
    recurrent.tokens(small, np.arange(0, len(small) + 1, 8000))
    assert tracemalloc.get_traced_memory()[1] < 16 * len(small)  # the tokens alone take four bytes a byte here
    tracemalloc.stop()
    for k, text in enumerate(texts):
        alone, _ = recurrent.tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ids[cut[k] : cut[k + 1]].tolist() == alone.tolist() and len(alone) == len(text.split()) + 1


def test_as_many_trainers_as_chosen(spark, monkeypatch):
    seen, frames = [], type(frame(spark))
    keep = frames.mapInArrow
    monkeypatch.setattr(frames, "mapInArrow", lambda self, f, kind, *a, **b: seen.append(self) or keep(self, f, kind, *a, **b))
    deal = frames.repartition
    monkeypatch.setattr(frames, "repartition", lambda self, n, *cols: deal(self, max(n, 40) if cols and isinstance(n, int) else n, *cols))
    docs = frame(spark, [(i, f"text {i} and more") for i in range(700)])
    counts = recurrent.token_counts(docs)
    recurrent.fit(docs, counts, trainers=5, rounds=1)
    dealt = next(d for d in seen[1:] if d.columns == ["text"])
    sizes = [len(x) for x in dealt.rdd.glom().collect()]
    assert len(sizes) == 5 and min(sizes) > 60  # however a cluster deals out keys; each trainer sends all weights


def test_long_documents_leave_no_windows_of_few_lanes(monkeypatch):
    """A document of 20,000 tokens among short ones had made 625 windows, most of them of it alone, with a step each."""
    rng, steps = np.random.default_rng(10), []
    sizes = [50] * 100 + [20_000] + [50] * 100
    at = np.cumsum([0, *sizes])
    h = rng.integers(10, 60, at[-1])
    model = recurrent.Model(np.arange(10, 60), np.ones(50), 5, 5)
    update = recurrent.Adam.update
    monkeypatch.setattr(recurrent.Adam, "update", lambda *a: steps.append(1) or update(*a))
    assert recurrent.train(model, h, at) == at[-1] == 30_000
    assert len(steps) <= 70
    ids, seen = np.arange(at[-1]), []  # tokens numbered by their places
    for x, new, y, where, _ in recurrent._windows(ids, at, 64, -5, even=True):
        there = where >= 0
        seen += where[there].tolist()
        starts = np.isin(where, at[:-1]) & there
        assert np.array_equal(y[there], where[there]) and np.all(new[starts])
        assert np.array_equal(x[there], np.where(starts, -5, where - 1)[there])
    assert sorted(seen) == list(range(at[-1]))  # every token once, after the one before it


def deep(v=6000, seed=11):
    rng = np.random.default_rng(seed)
    model = recurrent.Deep(np.arange(10, 10 + v), 1e6 / np.arange(1, v + 1), 50, 5, rng.normal(0, 1, (v, recurrent.TRAITS)))
    for k in ("root", "part", *(k for k, _ in model.layers)):
        model.w[k] = model.w[k] + np.where(model.w[k][:, -1:] > -1e8, rng.normal(0, 0.3, model.w[k].shape), 0).astype(np.float32)
    return model, rng


def test_a_large_vocabulary_takes_few_outputs():
    """Equal classes had taken some 580 outputs a token at 84,771 types."""
    v = 80_000
    counts = 1e7 / np.arange(1, v + 1)
    model = recurrent.Deep(np.arange(10, 10 + v), counts, 10**6, 5, np.zeros((v, recurrent.TRAITS)))
    width = np.concatenate([np.full(model.w[k].shape[0], model.w[k].shape[2]) for k, _ in model.layers])
    assert sorted(model.sorted.tolist()) == list(range(10, 10 + v)) and len(width) == model.classes
    assert np.all(np.diff(model.cls) >= 0) and np.bincount(model.cls)[:-1].max() <= width.max() and model.cls[-1] == model.classes
    share = counts[model.sorted[np.argsort(model.number)] - 10] / counts.sum()
    outputs = model.w["root"].shape[2] + model.w["part"].shape[2] + (share * width[model.cls[:-1]]).sum()
    print(outputs, model.classes)
    assert outputs < 0.3 * 2 * v**0.5 and model.classes < 3 * v**0.5


def test_deep_outputs_equal_a_plain_version():
    model, rng = deep()
    n, soft = 5000, lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    h, scale = rng.normal(0, 0.5, (n, recurrent.HIDDEN)).astype(np.float32), rng.random(n).astype(np.float32)
    y = np.where(rng.random(n) < 0.3, rng.integers(0, 20, n), rng.integers(0, model.n + 1, n))  # many rows of one class
    grad = {k: np.zeros_like(x) for k, x in model.w.items()}
    logp, dh = model.output(h, y, grad, scale)
    assert np.array_equal(logp, model.output(h, y)[0])
    want = {k: np.zeros(x.shape) for k, x in model.w.items()}
    touched = model.touched(y)
    for i, t in enumerate(y.tolist()):
        path, one = [("root", 0, model.parts)], np.append(h[i].astype(float), 1)
        if t < model.n:
            c = int(model.cls[t])
            name, lo = [x for x in model.layers if x[1] <= c][-1]
            path = [("root", 0, c // model.each), ("part", c // model.each, c % model.each), (name, c - lo, t - int(model.first[c]))]
            assert c - lo in touched[name]
        lp, back = 0, np.zeros(recurrent.HIDDEN)
        for k, node, child in path:
            w = model.w[k][node].astype(float)
            p = soft(one @ w)
            lp += np.log(p[child])
            d = scale[i] * (p - (np.arange(len(p)) == child))
            want[k][node] += np.outer(one, d)
            back += w[:-1] @ d
        assert abs(lp - logp[i]) < 1e-4 and np.allclose(back, dh[i], atol=1e-4)
    assert all(np.allclose(grad[k], want[k], atol=2e-3) for k in want)
    one = np.repeat(h[:1], model.n + 1, 0)
    assert abs(np.exp(model.output(one, np.arange(model.n + 1))[0].astype(float)).sum() - 1) < 1e-4


def test_classes_hold_tokens_of_like_documents():
    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 1000)
    docs = [rng.choice(np.arange(1, 1000), 200, p=share / share.sum()) * 2 + k % 2 for k in range(600)]  # two languages, of even and of odd tokens
    ids, cut = np.concatenate(docs) * 0x5851F42D4C957F2D, np.arange(0, 120_001, 200)
    sums, tokens = np.stack([np.repeat(t, 200) for t in recurrent.traits(ids, cut)], 1), np.unique(ids)
    kind = np.stack([sums[ids == t].mean(0) for t in tokens])
    odd = tokens % 2 == 1
    model = recurrent.Deep(tokens, np.full(len(tokens), 60.0), 1, 1, kind)
    cls = model.cls[model.numbers(tokens)]
    mixed = sum(min(odd[cls == c].sum(), (~odd[cls == c]).sum()) for c in range(model.classes))
    assert model.classes > 20 and mixed < 0.1 * len(tokens)


def test_large_vocabularies_are_scored(spark, monkeypatch):
    for name, value in (("HEAD", 6), ("FLAT", 2), ("FREQUENT", 3), ("SCORED", 5)):
        monkeypatch.setattr(recurrent, name, value)
    check(recurrent.score_documents(frame(spark)).collect(), BASE)
    rows = [(i, f"w{i % 40} w{i} common w{i % 40}") for i in range(400)]
    docs = frame(spark, rows)
    model, _, _, n_all, _ = recurrent.fit(docs, recurrent.token_counts(docs))
    assert isinstance(model, recurrent.Deep) and model.trained == n_all and np.any(model.w["root"][:, :-1])
    check(recurrent.score_documents(docs).collect(), rows)


def test_scores_do_not_hang_on_how_many_rows_are_made_at_once(monkeypatch):
    model, rng = deep()
    ids, at = rng.integers(5, 6020, 3000), np.array([0, 700, 701, 1500, 3000])
    want, _ = recurrent.log_probabilities(model, ids, at)
    monkeypatch.setattr(recurrent, "SCORED", 64)
    got, _ = recurrent.log_probabilities(model, ids, at, n_lanes=2)
    assert np.allclose(got, want, atol=1e-4)
