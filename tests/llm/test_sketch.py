import hashlib

import pytest
from pyspark.sql import functions as F

from acreline.llm import sketch
from acreline.llm.queries import ORACLE_SQL, op10_fingerprints
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def test_query_equals_its_sql_and_runs_no_python(spark):
    df = op10_fingerprints(spark, SF)
    assert not differences(df, connect(SF), ORACLE_SQL["op10_fingerprints"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_next_row_over_any_keys(spark):
    keys = [None, None, -5, -5, 0, 3, 3, 3, 10 ** 12, *range(100, 400, 7)]
    df = spark.createDataFrame([(k, f"t{i:03}") for i, k in enumerate(keys)], "k long, t string")
    got = sketch.next_of(sketch.dealt(df, "k"), "k", {"n": "t"}, ["t"]).collect()
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    want = {f"t{i:03}": f"t{order[(at + 1) % len(order)]:03}" for at, i in enumerate(order)}
    assert {r["t"]: r["n"] for r in got} == want


@pytest.mark.parametrize("kind", ["string", "date", "binary"])
def test_next_row_over_keys_that_are_no_numbers(spark, kind):
    df = spark.range(300).select(
        F.when(F.col("id") % 50 > 0, F.when(F.lit(kind == "date"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("string"))
               .otherwise(F.format_string("k%03d é", F.col("id")))).cast(kind).alias("k"), F.format_string("t%03d", "id").alias("t"))
    got = {r["t"]: r["n"] for r in sketch.next_of(sketch.dealt(df, "k"), "k", {"n": "t"}, ["t"]).collect()}
    order = [r["t"] for r in df.orderBy(F.asc_nulls_first("k"), "t").collect()]
    assert got == {t: order[(i + 1) % 300] for i, t in enumerate(order)}


def test_ids_may_be_text(spark, documents):
    some = documents.limit(40)
    want = {r["doc_id"]: r["near_next"] for r in sketch.fingerprint_edits(some).collect()}
    named = some.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    assert {int(r["doc_id"][1:]): r["near_next"] for r in sketch.fingerprint_edits(named).collect()} == want


def test_awkward_rows(spark, awkward, nothing):
    got = sketch.fingerprint_edits(awkward).collect()
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in awkward.collect()))
    made = sorted((r["n_chars"], r["edited_sha256"]) for r in got)
    want = []
    for at, (_, _, t) in enumerate(texts):
        cut = len(t) // 4
        e = t[:len(t) - cut] + texts[(at + 1) % len(texts)][2][:cut]
        want.append((len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert made == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert sketch.fingerprint_edits(nothing).count() == 0
    [alone] = sketch.fingerprint_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert alone["near_next"] == 1.0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_likeness_and_containment_are_near_the_truth(spark, share):
    words = [f"w{i}" for i in range(6000)]
    cut = int(share * 6000)
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:cut]))], "a string, b string")
    both = sketch.with_sketch(sketch.with_sketch(df, "a", "sa"), "b", "sb")
    r = both.select(sketch.likeness("sa", "sb").alias("j"), sketch.containment("sb", "sa").alias("c"),
                    (sketch.merge("sa", "sb") == F.col("sa")).alias("m")).first()
    assert abs(r["j"] - share) < 0.06 and r["c"] == 1.0 and r["m"]
