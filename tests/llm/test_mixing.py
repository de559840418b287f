import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from acreline.llm import mixing
from acreline.llm.queries import op7_mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 1.5 * sum(sizes), 2)
    assert all(t <= 2 * s + 1e-6 for t, s in zip(got, sizes))
    assert sum(got) == pytest.approx(min(1.5 * sum(sizes), 2 * sum(sizes)))
    free = {round(t / w, 6) for t, w, s in zip(got, weights, sizes) if t < 2 * s - 1e-6}
    assert len(free) <= 1  # all below their stop have the same share of their weight


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 65_537])
def test_index_permutation(size):
    got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 99, np.uint64))
    assert sorted(got.tolist()) == list(range(size))
    assert size < 64 or (got == np.arange(size)).mean() < 0.1


def test_each_source_comes_near_its_target(spark, documents):
    rows = op7_mixing(spark, "/root/testdata/sf0.001").collect()
    again = op7_mixing(spark, "/root/testdata/sf0.001").collect()
    key = lambda r: r["doc_id"]
    assert sorted(rows, key=key) == sorted(again, key=key) and len(rows) == documents.count()
    docs = {r["doc_id"]: r for r in documents.collect()}
    size = lambda t: len((t or "").encode().split())
    by = {}
    for r in rows:
        assert r["size"] == size(docs[r["doc_id"]]["text"]) and r["taken"] <= 2 * r["size"]
        by.setdefault(docs[r["doc_id"]]["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    for s, total, target in zip(names, sizes, want):
        assert {(r["source_size"], r["target"]) for r in by[s]} == {(total, target)}
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 64


def test_slots_take_every_block_once_before_any_twice(spark):
    got = mixing.slots(spark, [(0, "a", 1000, 1500.0), (1, None, 33, 10.0), (2, "z", 0, 0.0)], 10, 8, 1).collect()
    times = np.bincount([r["_block"] for r in got if r["_source"] == 0], minlength=100)
    assert times.sum() == 150 and set(times) == {1, 2}
    assert sum(r["_source"] == 1 for r in got) == 1 and {r["_shard"] for r in got} == set(range(8))


def test_shards_draw_their_slots():
    counts = [5_000, 0, 1_234, 7, 1]
    got = mixing.deal(counts, 16, 3)
    assert got.sum(axis=0).tolist() == counts and (got >= 0).all()
    sizes = got.sum(axis=1)
    assert sizes.max() - sizes.min() <= 1
    assert (got == mixing.deal(counts, 16, 3)).all() and (got != mixing.deal(counts, 16, 4)).any()
    # A draw, not an even deal, and near its expectation.
    share = got[:, 0] / sizes
    assert share.std() > 0.005 and abs(share - 5_000 / 6_242).max() < 0.1
    assert mixing.deal([3, 4], 1, 0).tolist() == [[3, 4]] and mixing.deal([0, 0], 3, 0).sum() == 0


def test_equal_rows_each_have_their_share(spark):
    rows = [(1, "a b c d e f g h", "x")] * 20 + [(2, "i j k", "x"), (None, "a b c d e f g h", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = sum(r["taken"] for r in mixing.mix(docs, block=4).collect())
    made = mixing.mixed_texts(docs, block=4).collect()
    assert sum(len(r["text"].split()) for r in made) == taken


def test_texts_hold_the_words_that_are_taken(spark, documents):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(documents).collect()}
    texts = mixing.mixed_texts(documents)
    assert texts.columns == documents.columns
    words, docs = {}, {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in texts.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(docs[r["doc_id"]].split())
    assert words == {i: n for i, n in taken.items() if n}


def test_awkward_rows(awkward, nothing):
    got = mixing.mix(awkward, block=4).collect()
    assert len(got) == awkward.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed_texts(awkward, block=4).columns == awkward.columns
    made = mixing.mixed_texts(awkward, block=4).collect()
    assert sum(len(r["text"].encode().split()) for r in made) == sum(r["taken"] for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_texts(nothing).count() == 0
