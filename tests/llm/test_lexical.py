import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from acreline.llm import lexical
from acreline.llm.queries import op13_lexical_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(items, docs, k=10):
    """By the contract's words: (item, rank, id, score)."""
    bags = [(i, collections.Counter(words(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scores = collections.Counter(words(text)), []
        for (doc, bag), n in zip(bags, sizes):
            total = 0
            for t, times in asked.items():
                if bag[t]:
                    m = 100 - 75 + (75 * n * n_docs) // length
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    total += times * w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if total > 0:
                scores.append((-total, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def frames(spark, items, docs):
    return (spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))


def key(x):
    return tuple((v is None, v or 0) for v in x)


def check(spark, items, docs, **options):
    got = sorted((tuple(r) for r in lexical.search(*frames(spark, items, docs), **options).collect()), key=key)
    assert got == sorted(plain(items, docs, options.get("k", 10)), key=key)


def test_query_equals_brute_force_and_sql(spark, documents):
    got = sorted(map(tuple, op13_lexical_search(spark, "/root/testdata/sf0.001").collect()))
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert got == sorted(plain([(r["item_id"], r["text"]) for r in items.collect()],
                               [(r["doc_id"], r["text"]) for r in documents.collect()]))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert got == sorted(con.execute(lexical.SEARCH_SQL).fetchall())


def made(n, seed, long=30):
    rng = random.Random(seed)
    return [(i, " ".join(f"W{min(int(rng.paretovariate(0.5)), 300)}" for _ in range(rng.randrange(long)))) for i in range(n)]


def test_many_buckets_blocks_and_ties(spark, monkeypatch):
    docs = made(900, 1, 60) + [(1000 + i, "w1 w2 w2 W7 w7") for i in range(60)]
    items = made(25, 2, 12) + [(50, "W7 w7 w2")]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)  # several blocks of items
    check(spark, items, docs)
    check(spark, items, docs, k=3)


@pytest.mark.parametrize("bucket", [1, 7, 64])
def test_pruning_keeps_every_best_document(bucket):
    """The search of one task against all scores; and it does prune."""
    rng = np.random.default_rng(bucket)
    queries = lexical.number_terms([" ".join(f"t{x}" for x in rng.integers(0, 40, 8)).encode() for _ in range(12)])
    w = rng.integers(0, 9, len(queries.vocabulary))
    vectors = []
    for _ in range(500):
        at = np.sort(rng.choice(len(w), rng.integers(1, 12), replace=False))
        vectors.append((at, w[at] * rng.integers(1, 5 + 200 * (rng.random() < 0.03), len(at))))
    norms = np.array([math.sqrt((v.astype(float) ** 2).sum()) for _, v in vectors])
    order = np.argsort(-norms, kind="stable")
    search = lexical.Search(queries, w, 5, np.zeros(12, np.int64))
    for lo in range(0, len(order), bucket):
        own = order[lo:lo + bucket]
        search.bucket(own.tolist(), [vectors[i] for i in own], norms[own])
    got = collections.defaultdict(list)
    for q, score, name in search.rows():
        got[q].append((-score, name))
    for q, (ids, counts) in enumerate(zip(queries.ids, queries.counts)):
        full = []
        for name, (at, v) in enumerate(vectors):
            row = dict(zip(at.tolist(), v.tolist()))
            s = sum(int(c) * row.get(int(t), 0) for t, c in zip(ids, counts))
            if s > 0:
                full.append((-s, name))
        assert got[q] == sorted(full)[:5]
    assert len(search.open) < 12


def test_terms():
    text = "A-bC dé\x00é9_É日本 ½"
    assert [t.decode() for p in lexical.terms(text.encode()) for t in p] == words(text) == ["a", "bc", "dé", "é9", "É日本", "½"]
    assert list(lexical.terms(None)) == [] == list(lexical.terms(b""))


def test_long_text_is_cut_between_terms(monkeypatch):
    text = " ".join(f"t{i}" for i in range(500)).encode() + b"x" * 300
    want = [t for p in lexical.terms(text) for t in p]
    monkeypatch.setattr(lexical, "PORTION_BYTES", 64)
    parts = list(lexical.terms(text))
    assert len(parts) > 10 and [t for p in parts for t in p] == want


def test_awkward_rows(spark, awkward, nothing):
    items = [(0, None), (1, ""), (2, "!?"), (3, "lorem one ONE mail"), (3, "lorem one ONE mail"), (4, "½ 日本"), (None, "id")]
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "'x' AS q")
    got = sorted((tuple(r) for r in lexical.search(frame, awkward).collect()), key=key)
    assert got == sorted(plain(items, docs), key=key)
    assert lexical.search(frame, nothing).count() == 0
    assert lexical.search(frame.limit(0), awkward).count() == 0
    assert lexical.search(frame, awkward.filter("text IS NULL")).count() == 0
