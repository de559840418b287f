import random
import zlib

import numpy as np

from acreline.llm import quality
from acreline.llm.queries import op9_quality


def table(spark, n=900, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(80)]
        good = rng.random() < 0.7
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "x"))
        labels.append((i, int(good), 0))
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(out) > 200 and np.mean([(r["_llm_score"] >= 0.5) == (r["quality"] == 1) for r in out]) > 0.98


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = table(spark, 300)
    flipped = labels.selectExpr(
        "doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    assert quality.train(docs, labels) == quality.train(docs, flipped)


def test_query_is_whole_and_repeats(spark, documents):
    a, b = (sorted(op9_quality(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert a == b and len(a) == documents.count()
    for r in a:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_awkward_rows(spark, awkward, nothing):
    docs, labels = table(spark, 300)
    model = quality.train(docs, labels)
    got = quality.score(awkward, model, keep=awkward.columns)
    assert got.columns == [*awkward.columns, "_llm_score"] and got.count() == awkward.count()
    assert all(0 <= r["_llm_score"] <= 1 for r in got.collect())
    assert quality.score(nothing, model).count() == 0
    none = quality.train(awkward, spark.createDataFrame([(3, 1, 0), (None, 0, 0)], labels.schema))
    assert {r["_llm_score"] for r in quality.score(awkward, none).collect()} == {0.5}


def test_texts_are_passed_on_a_few_rows_at_a_time(spark, monkeypatch):
    docs, labels = table(spark)
    seen, frame = [], type(docs)
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: (seen.append(f), real(self, f, *a, **b))[1])
    scored = quality.score(docs, quality.train(docs, labels), keep=docs.columns).collect()
    [whole] = docs.toArrow().combine_chunks().to_batches()
    out = list(seen[0](iter([whole])))
    assert max(map(len, out)) <= 256 < len(whole)
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [tuple(r) for r in scored]
