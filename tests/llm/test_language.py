import collections
import math
import random
import zlib

import numpy as np

from acreline.llm import language
from acreline.llm.queries import op11_language


def plain_grams(text):
    """n-grams of one to three letters, words padded by a space."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in line:
        line = line.replace("  ", " ")
    return collections.Counter(line[i:i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i:i + n] != " ")


def test_grams_are_those_of_the_definition(monkeypatch):
    for text in ("Aß b", "naïve ½ 日本--x", "a", "One two, three.", "x " * 50):
        want = plain_grams(text)
        got = language.gram_counts(text)
        assert got.sum() == sum(want.values())
        assert (got > 0).sum() <= len(want)
        monkeypatch.setattr(language, "PORTION", 3)
        assert (language.gram_counts(text) == got).all(), text  # cuts lose and add nothing
        monkeypatch.undo()
    assert language.gram_counts(None) is None and language.gram_counts("12 ½ !") is None and language.gram_counts("") is None


def test_query_names_held_out_languages(spark, documents):
    got = op11_language(spark, "/root/testdata/sf0.001").collect()
    want = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert len(got) == len(want)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in want if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_it_is_the_nearest_centroid(spark, documents):
    """Predictions against plain cosines in double precision."""
    rows = documents.filter("lang IS NOT NULL").selectExpr("doc_id AS id", "lang", "text")
    model = language.train(rows, clusters=3, sample_docs=40)
    assert len(set(model.of.tolist())) == len(model.languages) == 4 and len(model.of) > 4  # several per language
    np.testing.assert_allclose(np.linalg.norm(model.centroids, axis=0), 1, atol=1e-4)
    texts = {r["id"]: r["text"] for r in rows.collect()}
    df = np.sum([language.gram_counts(t) > 0 for t in texts.values()], axis=0)
    np.testing.assert_allclose(model.idf, np.log((1 + len(texts)) / (1 + df)) + 1)
    for r in language.predict(documents, model).collect():
        counts = language.gram_counts(texts[r["doc_id"]])
        v = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * model.idf, 0)
        near = (v / np.linalg.norm(v)) @ model.centroids
        assert model.languages[model.of[near.argmax()]] == r["lang_pred"]
        assert math.isclose(near.max(), r["score"], rel_tol=1e-5)
        assert r["rejected"] == (r["score"] < model.nearest[near.argmax()]) or abs(r["score"] - model.nearest[near.argmax()]) < 1e-5


def test_far_text_is_rejected(spark, documents):
    rows = documents.filter("lang IS NOT NULL").selectExpr("doc_id AS id", "lang", "text")
    model = language.train(rows)
    rng = random.Random(3)
    strange = " ".join("".join(rng.choice("бгджзйлфцчшщыэюя") for _ in range(6)) for _ in range(200))
    got = language.predict(spark.createDataFrame([(1, strange)], "doc_id long, text string"), model).first()
    assert got["rejected"] and got["lang_pred"] in model.languages and got["score"] < 0.2


def test_clusters_part_different_kinds():
    rng = np.random.default_rng(5)
    rows = np.concatenate([np.eye(6)[k] + 0.05 * rng.random((20, 6)) for k in (0, 3)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centres, near = language.cluster(rows, 2)
    assert len(centres) == 2 and len(set(near[:20].argmax(axis=1))) == len(set(near[20:].argmax(axis=1))) == 1
    assert near.max(axis=1).min() > 0.97
    assert len(language.cluster(np.repeat(rows[:1], 9, axis=0), 4)[0]) == 1  # copies have one centre


def test_awkward_rows(spark, awkward, nothing):
    got = language.identify(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r["doc_id"]: r for r in got}
    for i in (0, 1, 2):  # NULL, empty, blank
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0
    assert {r["lang_pred"] for r in got} == {"und", "en"}
    assert by_id[None]["held_out"]
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 6}) == 1
    assert language.identify(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language.identify(unlabelled).first()["lang_pred"] == "und"


def test_one_language_with_most_rows_is_sampled_within_the_bound(spark):
    rows = [(i, "aa", f"abc def ghi {i % 7}") for i in range(3_000)] + [(i, "bb", "xyz uvw xyz") for i in range(3_000, 3_005)]
    got = language.train(spark.createDataFrame(rows, "id long, lang string, text string"), sample_docs=50)
    assert got.languages == ["aa", "bb"]
