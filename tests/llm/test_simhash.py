import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from acreline.llm import simhash
from acreline.llm.queries import op6_simhash


def plain_fingerprint(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(rows, got, width, radius):
    fps = {i: plain_fingerprint(t, width) for i, t in rows}
    ids = sorted(fps)
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= radius])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(int(r["fingerprint"], 16) == fps[r["doc_id"]] for r in got)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab \n\x0bÉé"), max_size=60), st.integers(1, 6))
def test_fingerprint(text, width):
    assert simhash.fingerprint(text.encode(), width) == plain_fingerprint(text, width)


def test_query_on_a_small_table_equals_brute_force(spark, documents):
    got = op6_simhash(spark, "/root/testdata/sf0.001").collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got)
    check([(r["doc_id"], r["text"]) for r in documents.collect()], got, 3, 2)


def test_every_pair_within_the_radius_is_linked(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                b ^= 1 << bit
            fps.add(b)  # chains of near fingerprints
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    unsigned = lambda f: f & ((1 << 64) - 1)
    want = roots(signed, [(a, b) for a in signed for b in signed
                          if a < b and (unsigned(a) ^ unsigned(b)).bit_count() <= 2])
    assert {f: got.get(f, f) for f in signed} == want


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)],
                                   [(5, 9), (9, 5), (9, 9), (1, 2)]])
def test_components(spark, edges):
    got = simhash.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long"))
    nodes = {x for e in edges for x in e}
    assert {r["node"]: r["root"] for r in got.collect()} == {
        n: r for n, r in roots(nodes, edges).items() if n in nodes}


def test_awkward_rows(spark, awkward, nothing):
    got = simhash.near_duplicates(awkward, width=3).collect()
    assert len(got) == awkward.count()
    blank = [r for r in got if r["fp"] == 0]
    assert {r["component_id"] for r in blank} == {0} and len(blank) == 3
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(nothing).count() == 0


def near(words, rng, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"edit{rng.getrandbits(30)}"
    return out


def test_similar_texts_are_found_and_others_are_not(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, pairs = [], []
    for i in range(0, 160, 2):
        text = [word() for _ in range(300)]
        rows += [(i, " ".join(text)), (i + 1, " ".join(near(text, rng, 0.008 if i < 80 else 0.15)))]
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    for i in range(0, 160, 2):
        pairs.append((i, len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    close = [i for i, j in pairs if j >= 0.85]
    assert len(close) > 30 and sum(i + 1 not in kept for i in close) >= 0.95 * len(close)
    assert all(i in kept and i + 1 in kept for i, j in pairs if j < 0.8)


def test_near_pairs_inside_a_family_below_the_similarity(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(0, 300, 2):  # about 0.7 between members, about 0.9 within a pair
        text = near(base, rng, 0.02)
        rows += [(i, " ".join(text)), (i + 1, " ".join(near(text, rng, 0.01)))]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    alike = [(a, b) for b in range(300) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = roots(range(300), alike)
    assert len(set(group.values())) > 40
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["h"]: r["root"] for r in got.collect()}
    hashes = [r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string")
              .orderBy("doc_id").select(simhash.text_hash("text").alias("h")).collect()]
    assert [i for i in range(0, 300, 2) if group[i] == group[i + 1] and got[hashes[i]] != got[hashes[i + 1]]] == []


def test_a_family_below_the_similarity_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Its texts meet in the buckets, but none is compared with a text that it cannot be alike with."""
    rng, made, alike = random.Random(7), [], simhash.alike
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(near(base, rng, 0.025))) for i in range(240)]
    rows += [(240 + k, rows[8 * k][1] + " more words") for k in range(30)]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    close = [(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def counted(docs, pairs, *rest):
        pairs = simhash.stored(pairs)
        made.append(pairs.count())
        return alike(docs, pairs, *rest)

    monkeypatch.setattr(simhash, "alike", counted)
    got = {r["h"]: r["root"] for r in simhash.similar_texts(docs).collect()}
    hashes = [r["h"] for r in docs.orderBy("doc_id").select(simhash.text_hash("text").alias("h")).collect()]
    found = roots(range(len(rows)), close)
    assert len(made) == 2 and made[1] <= 3 * len(rows)
    assert all(got[hashes[8 * k]] == got[hashes[240 + k]] for k in range(30))
    wrong = [(a, b) for a in range(len(rows)) for b in range(a) if got[hashes[a]] == got[hashes[b]] and found[a] != found[b]]
    assert wrong == []


def test_one_row_of_each_group_stays(awkward, nothing, documents):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert [i for null, i in ids if not null] == [0, 3, 4, 5, 6, 8] and len(ids) == 7
    assert simhash.keep_one(nothing).count() == 0
    assert simhash.keep_one(documents.union(documents)).count() == simhash.keep_one(documents).count()


def test_a_key_is_told_from_its_variants(spark):
    keys = spark.createDataFrame([(0,), (1,), (5 << 32,), ((11 << 32) + (1 << 32) - 1,)], "key long")
    each = keys.select("key", F.posexplode(simhash.variants_of("key")).alias("nth", "v"))
    each = each.withColumn("back", simhash.key_of("v", "nth"))
    assert each.count() == 4 * 33 and each.filter("back != key").count() == 0


def test_variants_travel_in_one_long(spark, monkeypatch):
    """They are the largest shuffle: 33 for each fingerprint of each text."""
    plans, stored = [], simhash.stored

    def kept(df):
        if df.columns == ["v", "key"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(simhash, "stored", kept)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f h")], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 2
    sent = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_v" in line]
    assert len(sent) == 1 and not any("Exchange hashpartitioning(v#" in line for plan in plans for line in plan.splitlines())


def test_few_edges_are_tied_without_an_exchange(spark, monkeypatch):
    """A round over 211 partitions costs a thousand tasks, however few the edges are."""
    plans, stored = [], simhash.stored

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(simhash, "stored", kept)
    simhash.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"))
    assert len(plans) > 2 and not any("Exchange" in plan for plan in plans[1:])


@pytest.mark.parametrize("most", [1, 60])
def test_components_of_more_edges_than_a_task_takes(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "EDGES_AT_ONCE", most)
    edges = [(i, i + 1) for i in range(70) if i % 7] + [(100, i) for i in range(101, 140)] + [(3, 120)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == roots({x for e in edges for x in e}, edges)


def test_only_wanted_texts_are_dealt_by_hash(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e {i}") for i in range(9)] + [(9, "a b c d e 1")], "doc_id long, text string")
    hashes = docs.select(simhash.text_hash("text").alias("h")).filter("h % 2 = 0").distinct()
    sets = simhash.shingle_sets(docs, hashes, 5, "text")
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("Exchange hashpartitioning")[1] and "SortMergeJoin" not in plan
    monkeypatch.setattr(simhash, "SENT_HASHES", 0)
    more = simhash.shingle_sets(docs, hashes, 5, "text")
    as_sets = lambda df: sorted((r["h"], sorted(r["set"])) for r in df.collect())
    assert as_sets(sets) == as_sets(more) and len(as_sets(sets)) == hashes.count()


def test_rounds_end_without_comparing_all_edges(spark, monkeypatch):
    monkeypatch.delattr(type(spark.range(0)), "exceptAll")
    got = simhash.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]
