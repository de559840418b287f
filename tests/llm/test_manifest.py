import hashlib
import zlib

import duckdb
import pytest

from acreline.llm import manifest
from acreline.llm.queries import op12_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, lower=False):
    out = []
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = r[c]
        if v is None:
            out.append("-")
            continue
        v = str(v)
        if lower and c == "text":
            v = "".join(x.lower() if "A" <= x <= "Z" else x for x in v)
        out.append(f"{len(v.encode())}:{v}")
    return h(*out)


def climb(nodes):
    """(root, proof of each node as runs of (before, after))."""
    proofs, where, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, at in enumerate(where):
            lo = at // 8 * 8
            proofs[i].append((level[lo:at], level[at + 1:lo + 8]))
        where = [at // 8 for at in where]
        level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], proofs


def plain(rows):
    """The contract in plain Python; ids may repeat, equal ids stand by leaf."""
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups, subroots = {}, {}
    for lang in langs:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), plain_leaf(r, True), r["doc_id"])
                      for r in rows if r["lang"] == lang))
        subroots[lang], proofs = climb([x[2] for x in own])
        groups[lang] = list(zip(own, proofs))
    root, tops = climb([subroots[lang] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for (_, _, leaf, lower, doc_id), proof in groups[lang]:
            path = proof + top
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            node = lower if changed else leaf
            for left, right in path:
                node = h(*left, node, *right)
            digest = h(*[x for left, right in path for x in left + right])
            out.append((doc_id, leaf, subroots[lang], root, digest, node, node == root))
    return out


def key(x):
    return (x[0] is not None, x[0] or 0, *x[1:])


def check(df, got):
    want = sorted(plain([r.asDict() for r in df.collect()]), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_equals_brute_force_and_sql(spark, documents):
    got = op12_manifest(spark, "/root/testdata/sf0.001")
    check(documents, got)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.execute(manifest.MANIFEST_SQL).fetchall()) == sorted(map(tuple, got.collect()))
    assert {r["verified"] for r in got.select("verified").distinct().collect()} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_around_the_fan(spark, n):
    df = spark.createDataFrame([(i, "s", "en", 1, f"Text {i}") for i in range(n)], COLUMNS)
    check(df, manifest.manifest(df))


@pytest.mark.parametrize("height", [1, 2])
def test_several_rounds_of_superblocks(spark, height):
    """Low superblocks, so that three rounds and more meet; a language with most rows among many small ones."""
    rows = [(i * 7 % 601, "s", "big" if i < 580 else f"l{i}", i, f"A text {i}") for i in range(601)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    check(df, manifest.manifest(df, height=height))


def test_awkward_rows(spark, awkward, nothing):
    check(awkward, manifest.manifest(awkward))
    assert manifest.manifest(nothing).count() == 0


def test_ids_keep_their_type_and_digits(spark):
    big = 2 ** 62 + 1
    df = spark.createDataFrame([(big, None, None, None, ""), (None, "", "", 0, None)], COLUMNS)
    check(df, manifest.manifest(df))
    named = df.selectExpr("concat('x', doc_id) AS doc_id", "source", "lang", "n_chars", "text")
    assert {r["doc_id"] for r in manifest.manifest(named).collect()} == {f"x{big}", None}


def test_copies_are_leaves_of_their_own(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "Same")] * 70 + [(2, "s", "en", 1, "other")] * 3, COLUMNS)
    check(df, manifest.manifest(df))
