import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa

from acreline.llm import lm
from acreline.llm.queries import op5_lm_scores


def plain(rows):
    """Tokens and base scores by the definition."""
    counts, words = collections.Counter(), []
    for i, text in rows:
        w = [*(text or "").encode().lower().split(), b""]
        words.append(w)
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) for w in words]
    return [(i, len(w), sum(counts[x] > 0 for x in w), n, b) for (i, _), w, b in zip(rows, words, base)]


def check(rows, got):
    key = lambda x: (x[0] is None, x[0] or 0, x[4])
    have = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], key=key)
    want = sorted(plain(rows), key=key)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    np.testing.assert_allclose([h[4] for h in have], [w[4] for w in want], rtol=1e-9)


def test_query_counts_and_beats_the_base_on_held_out_text(spark, documents):
    got = op5_lm_scores(spark, "/root/testdata/sf0.001").collect()
    check([(r["doc_id"], r["text"]) for r in documents.collect()], got)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0}
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_it_learns_what_follows_what(spark):
    rng, rows = random.Random(2), []
    follow = {f"w{i}": [f"w{(7 * i + k) % 60}" for k in (1, 2)] for i in range(60)}
    for i in range(400):
        words = [f"w{rng.randrange(60)}"]
        while len(words) < 200:
            words.append(rng.choice(follow[words[-1]]))
        rows.append((i, " ".join(words)))
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    per_token = sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert per_token > -0.8 > -1.5 > sum(r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)


def test_probabilities_sum_to_one(spark, documents):
    counts = lm.count_words(documents.select("text"))
    v = lm.learn_vocabulary(counts)
    weights = lm.train(documents, v, "doc_id", "text", rounds=1)
    context = np.array([lm.START] * 3 + [3, 9, 0])
    total = 0.0
    for o in range(lm.OUTPUTS):
        total += 10 ** lm.log_probabilities(weights, np.array([o]), context, np.array([5]))[0]
    assert abs(total - 1) < 1e-4
    # Within a bucket: its words and one unseen word.
    for b in range(lm.TAILS):
        own = v.inside[v.output == lm.OUTPUTS - lm.TAILS + b]
        unseen = math.log10(0.1) - v.tail_total[b]
        assert abs((10 ** own).sum() + 10 ** unseen - 1) < 1e-9


def test_one_step_is_the_gradient_of_the_definition():
    """A batch in plain Python: softmax by class and within it, summed gradients, shrinking steps."""
    rng = np.random.default_rng(4)
    outs, words = rng.integers(0, lm.OUTPUTS, 30), rng.integers(1, 9, 33)
    real = np.arange(3, 33)
    start = (rng.normal(size=(lm.CLASS_ROWS, lm.CLASSES)).astype("f4"), rng.normal(size=(lm.WORD_ROWS, lm.CLASSES)).astype("f4"))
    trainer = lm.Trainer(start)
    trainer.step(outs, words, real)
    cls, word = outs // lm.CLASSES, outs % lm.CLASSES
    logs = lm.log_probabilities(start, outs, words, real)
    for k, (rows, target) in enumerate(zip(lm._rows(lm.features(words)[:, real], cls), (cls, word))):
        sums, p = {}, []
        for t in range(30):
            z = start[k][rows[:, t]].astype(float).sum(axis=0)
            e = np.exp(z - z.max())
            p.append(e / e.sum())
            g = -p[-1]
            g[target[t]] += 1
            for r in rows[:, t].tolist():
                sums[r] = sums.get(r, 0) + g
        want = start[k].astype(float).copy()
        for r, g in sums.items():
            want[r] += lm.RATE * g / np.sqrt(1 + (g * g).sum())
        np.testing.assert_allclose(trainer.weights[k], want, atol=2e-5)
        logs -= np.log10([p[t][target[t]] for t in range(30)])
    np.testing.assert_allclose(logs, 0, atol=1e-5)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = lm.score(awkward).collect()
    check(rows, got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 6]
    assert len(same) == 3 and max(same) - min(same) < 1e-9
    assert lm.score(nothing).count() == 0
    only = lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert only[0]["train_tokens"] == 0 and only[0]["n_known"] == 0 and math.isfinite(only[0]["score"])


def test_weights_far_apart_keep_their_softmax():
    """The maximum is taken off only where exponentials would leave single precision."""
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 40, (lm.FEATURES, 25))
    for scale in (1, 11, 400):
        weights = (scale * rng.normal(size=(40, lm.CLASSES))).astype("f4")
        z = weights[rows].astype(float).sum(axis=0)
        want = np.exp(z - z.max(axis=1, keepdims=True))
        np.testing.assert_allclose(lm._softmax(weights, rows), want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_a_step_puts_each_row_back_once(monkeypatch):
    """Rows with one token are not added up, and only rows with tokens change."""
    added = []

    class Add:
        @staticmethod
        def reduceat(x, start, axis):
            added.append((len(x), len(start)))
            return np.add.reduceat(x, start, axis=axis)

    class Numpy:
        add = Add

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(lm, "np", Numpy())
    words, real = np.array([lm.START] * 3 + [7, 8, 9, 7, 8, 5]), np.arange(3, 9)
    outs = np.array([3, 40, 77, 3, 40, 120])
    start = (np.zeros((lm.CLASS_ROWS, lm.CLASSES), "f4"), np.zeros((lm.WORD_ROWS, lm.CLASSES), "f4"))
    trainer = lm.Trainer(start)
    trainer.step(outs, words, real)
    for k, (rows, _) in enumerate(zip(lm._rows(lm.features(words)[:, real], outs // lm.CLASSES), "ab")):
        changed = set(np.flatnonzero(np.abs(trainer.weights[k]).sum(axis=1)).tolist())
        assert changed == set(rows.ravel().tolist())
        count = collections.Counter(rows[1:].ravel().tolist())
        assert added[k] == (sum(n for n in count.values() if n > 1), sum(n > 1 for n in count.values()))


def test_texts_are_split_and_looked_up_once(spark, documents, monkeypatch):
    """Training and scoring read the words' numbers, not the texts."""
    made, read, look_up, train = [], [], lm.look_up, lm.train_numbers
    monkeypatch.setattr(lm, "look_up", lambda *args: made.append(1) or look_up(*args))
    monkeypatch.setattr(lm, "train_numbers", lambda numbers, *args: read.append(numbers.columns) or train(numbers, *args))
    lm.score(documents.limit(50))
    assert made == [1] and len(read) == 1 and not {"t", "text"} & set(read[0])


def test_numbers_of_texts_by_the_definition(awkward):
    """Known words by index, others by bucket and hash; a text above a portion has several rows, the last with its end."""
    v = lm.learn_vocabulary(lm.count_words(awkward.filter("doc_id % 2 = 0").select("text")))
    got = lm.look_up(awkward.filter("doc_id < 6 OR doc_id = 8"), v, "doc_id", "text").collect()
    texts, rare = {r["doc_id"]: r["text"] for r in awkward.collect()}, collections.Counter()
    rows = collections.defaultdict(list)
    for r in got:
        if r["word"] is None:
            rows[r["id"]].append(r)
        else:
            rare[r["id"], r["word"]] += 1
    assert set(rows) == {0, 1, 2, 3, 4, 5, 8} and len(rows[5]) == 2
    for i, own in rows.items():
        words = [*(texts[i] or "").encode().lower().split(), b""]
        codes = np.concatenate([np.frombuffer(r["codes"], "<i4") for r in own])
        marks = np.concatenate([np.frombuffer(r["marks"], "<u4") for r in own])
        unknown = [w for w in words if w not in v.words]
        assert codes.tolist() == [v.words.index(w) if w in v.words else -1 - lm.bucket_of(w) for w in words]
        assert marks.tolist() == [zlib.crc32(w) for w in unknown]
        assert collections.Counter(unknown) == {w: n for (j, w), n in rare.items() if j == i}
        assert [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        assert sum(r["tokens"] for r in own) == len(words) and sum(r["known"] for r in own) == len(words) - len(unknown)


def test_runs_stop_at_portions_and_ends():
    """Also in a part of a batch, as Arrow may hand it over."""
    codes = [[1, 0], [0], [2, -3, 4, 5], [6, -2, 0], [7, 0]]
    last = [True, True, False, True, True]
    flat = np.array(sum(codes, []), "<i4")
    columns = [lm._binary(flat, np.array([*map(len, codes)])), lm._binary(np.array([70, 80], "<u4"), np.array([0, 0, 1, 1, 0])), pa.array(last)]
    batch = pa.RecordBatch.from_arrays(columns, names=["codes", "marks", "last"])
    output = np.arange(10) + 100
    runs = [(own.tolist(), outs.tolist(), context.tolist(), ends.tolist()) for _, own, outs, context, ends in lm._runs(batch.slice(1), output, 3)]
    tail = lm.OUTPUTS - lm.TAILS
    assert runs == [
        ([0, 2, -3, 4, 5], [100, 102, tail + 2, 104, 105], [1, 3, (1 << 32) + 70, 5, 6], [True, False, False, False, False]),
        ([6, -2, 0], [106, tail + 1, 100], [7, (1 << 32) + 80, 1], [False, False, True]),
        ([7, 0], [107, 100], [8, 1], [False, True])]
    assert [len(run[1]) for run in lm._runs(batch, output, 1)] == [1, 1, 1, 4, 2, 1, 1, 1]
    assert [run[0] for run in lm._runs(batch, output, 100)] == [slice(0, 12)]


def test_buckets_of_counted_words(spark):
    words = ["a", "ab", "abc", "abcd", "日本", "xyzé"]
    got = lm.count_words(spark.createDataFrame([(" ".join(words),)], "text string")).collect()
    assert {r["word"]: r["bucket"] for r in got} == {w: lm.bucket_of(w) for w in [*(x.encode() for x in words), b""]}
