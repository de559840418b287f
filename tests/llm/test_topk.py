import numpy as np
import pytest
from pyspark.sql import functions as F

from acreline.llm.queries import ORACLE_SQL, op4_top_k
from acreline.llm.topk import top_k
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def brute(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable[i] = [int(np.floor(256 * float(x))) for x in v]
    out = []
    for q in (i for i in usable if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_query_equals_its_sql(spark):
    assert not differences(op4_top_k(spark, SF), connect(SF), ORACLE_SQL["op4_top_k"])


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force_with_copies_and_ties(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    vectors = centres[rng.integers(0, 5, 1500)] + 0.1 * rng.normal(size=(1500, 6))
    vectors[rng.integers(0, 1500, 500)] = vectors[0]  # a third is one vector
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1500, None), (1501, [None] * 6), (1502, [float("nan")] * 6), (1503, [float("inf")] * 6),
             (1504, []), (None, rows[0][1]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows, 5, 50)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0, -1e6]), (1, [0.5, 1e6])], schema)
    assert sorted(map(tuple, top_k(two, F.lit(True)).collect())) == brute(
        [(0, [1.0, -1e6]), (1, [0.5, 1e6])], 5, 1)
