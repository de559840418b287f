"""Exact top-k inner products by a pivot-distance index.

A vector v gets one more component, sqrt(M^2 - |v|^2) with M the largest norm, a query gets 0
there; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, and the highest inner products are the nearest
neighbours. Vectors are keyed by their nearest pivot and the distance to it. By the triangle
inequality |q - v| >= ||q - p| - |v - p||, so an annulus around a pivot bounds the inner
products within. A query first searches its own pivot; the k-th best score found there then
says which other pivots can still matter, and within a block annuli are expanded outwards from
the query's own distance until the bound falls below its k-th best. Only the pivots are fitted
on a bounded sample; every vector is indexed and nothing is dropped that a bound does not rule out.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.llm.common import shuffle_partitions, stored

SAMPLE = 8192
MOST_PIVOTS = 256
ANNULUS = 128
QUERIES_AT_ONCE = 2048


def usable(vec: str) -> Column:
    """Vectors that are not NULL or empty and hold no NULL, NaN or infinite component."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ok


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point while that is exact, else in Python integers."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Pivots by a few rounds of k-means from evenly spaced rows of the sample."""
    sample = np.unique(sample, axis=0)
    pivots = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].astype(float)
    for _ in range(rounds):
        near = _distances(sample, pivots).argmin(axis=1)
        total = np.zeros_like(pivots)
        np.add.at(total, near, sample)
        count = np.bincount(near, minlength=len(pivots))[:, None]
        pivots = np.where(count > 0, total / np.maximum(count, 1), pivots)
    return pivots


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0))


def _raised(v: np.ndarray, most: float) -> np.ndarray:
    v = v.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))])


def _slack(most: float) -> float:
    """What rounding can add to a squared distance; bounds are widened by it."""
    return 1e-9 * max(1.0, most)


def _order(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Column order by score, high to low, then id; row by row."""
    return np.lexsort((ids, ~score), axis=1)


def _search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
            dist: np.ndarray, pivot: np.ndarray, most: float, k: int):
    """Top k of one block for each query: rows (query index, vec_id, score).

    `floor` is a score that k vectors elsewhere already reach. Annuli of the block are visited
    outwards from each query's distance to the pivot; one whose bound is below the query's
    k-th best is skipped, as are all beyond it on that side.
    """
    order = np.lexsort((ids, dist))
    vectors, ids, dist = vectors[order], ids[order], dist[order]
    raised = np.column_stack([queries.astype(float), np.zeros(len(queries))])
    to_pivot = _distances(raised, pivot[None])[:, 0]
    q2 = (queries.astype(float) ** 2).sum(axis=1)
    starts = np.arange(0, len(ids), ANNULUS)
    ends = np.minimum(starts + ANNULUS, len(ids))
    lo, hi = dist[starts], dist[ends - 1]
    gap = np.maximum(0, np.maximum(to_pivot[:, None] - hi[None], lo[None] - to_pivot[:, None]))
    bound = (q2[:, None] + most - gap * gap) / 2 + _slack(most)
    best = np.full((len(queries), k), np.iinfo(np.int64).min)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    near = np.argsort(gap, axis=1, kind="stable")
    for step in range(len(starts)):
        at = near[:, step]
        kth = np.maximum(best[:, -1], floor)
        live = np.flatnonzero(bound[np.arange(len(queries)), at] >= kth)
        if not len(live):
            break  # bounds only fall from here on
        for annulus in np.unique(at[live]):
            rows = live[at[live] == annulus]
            part = slice(starts[annulus], ends[annulus])
            score = _products(queries[rows], vectors[part])
            score[own[rows][:, None] == ids[part][None]] = np.iinfo(np.int64).min
            all_s = np.concatenate([best[rows], score], axis=1)
            all_i = np.concatenate([who[rows], np.broadcast_to(ids[part], score.shape)], axis=1)
            top = _order(all_s, all_i)[:, :k]
            best[rows] = np.take_along_axis(all_s, top, axis=1)
            who[rows] = np.take_along_axis(all_i, top, axis=1)
    found = best > np.iinfo(np.int64).min
    q, c = np.nonzero(found)
    return q, who[q, c], best[q, c]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, exact.

    Components become floor(scale * x). `is_query` is a condition on the given columns. Scores
    tie to the smaller id; a query's own id is no candidate; with fewer than k candidates all
    are returned. Rows with a NULL id or a vector that `usable` refuses take no part, nor do
    vectors of another length than the most common one. Rows equal in id and vector count once.
    """
    spark = vectors.sparkSession
    lifted = vectors.select(
        F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_e"),
        F.coalesce(is_query, F.lit(False)).alias("_q")).filter(F.col("_id").isNotNull() & usable("_e"))
    whole = lifted.select("_id", "_q", F.transform(
        "_e", lambda x: F.floor(x.cast("double") * scale)).cast("array<bigint>").alias("_v")).distinct()
    whole = stored(whole.withColumn("_n2", F.aggregate(
        "_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    schema = "query_id long, rank int, vec_id long, score long"
    sizes = whole.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n"), F.max("_n2").alias("m")).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, total, most = max(((r["d"], r["n"], r["m"]) for r in sizes), key=lambda r: (r[1], r[0]))
    whole = whole.filter(F.size("_v") == dim)
    picked = whole.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_v").toArrow()
    pivots = fit_pivots(_raised(_matrix(picked.column("_v"), np.int64), most),
                        int(min(MOST_PIVOTS, max(1, total ** 0.5 / 4))))
    shared = spark.sparkContext.broadcast(pivots)

    def keyed(batches):
        pivots = shared.value
        for batch in batches:
            if not len(batch):
                continue
            far = _distances(_raised(_matrix(batch.column("_v"), np.int64), most), pivots)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_q"), batch.column("_v"), pa.array(near.astype("i4")),
                 pa.array(far[np.arange(len(near)), near])], names=["_id", "_q", "_v", "_p", "_dist"])

    index = stored(whole.select("_id", "_q", "_v").mapInArrow(
        keyed, "_id long, _q boolean, _v array<bigint>, _p int, _dist double"))
    # At most one row for each pivot.
    cells = {r["_p"]: (r["n"], r["lo"], r["hi"]) for r in index.groupBy("_p").agg(
        F.count("*").alias("n"), F.min("_dist").alias("lo"), F.max("_dist").alias("hi")).collect()}
    per_block = max(512, -(-total // (8 * shuffle_partitions(spark))))
    blocks = {p: max(1, -(-n // per_block)) for p, (n, _, _) in cells.items()}
    salts = F.create_map(*[F.lit(x) for p in sorted(blocks) for x in (p, blocks[p])])
    data = index.select("_p", F.pmod(F.xxhash64("_id"), salts[F.col("_p")]).cast("int").alias("_b"),
                        F.col("_id").alias("_vid"), F.col("_v").alias("_vec"), "_dist")

    def searched(pairs: DataFrame) -> DataFrame:
        """Search each (query, pivot) pair, in blocks of queries by blocks of vectors."""
        pairs = pairs.withColumn("_b", F.explode(F.sequence(F.lit(0), salts[F.col("_p")] - 1)))
        chunks = {r[0]: -(-r[1] // QUERIES_AT_ONCE) for r in pairs.filter("_b = 0").groupBy("_p").count().collect()}
        if not chunks:
            return spark.createDataFrame([], "query_id long, vec_id long, score long")
        table = F.create_map(*[F.lit(x) for p in sorted(chunks) for x in (p, chunks[p])])
        asked = pairs.withColumn("_c", F.pmod(F.xxhash64("_id"), table[F.col("_p")]).cast("int"))
        held = (data.filter(table[F.col("_p")].isNotNull())
                .withColumn("_c", F.explode(F.sequence(F.lit(0), (table[F.col("_p")] - 1).cast("int")))))

        def block(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not len(asked) or not len(held):
                found = (np.zeros(0, np.int64),) * 2
                names = np.zeros(0, np.int64)
            else:
                own = asked.column("_id").to_numpy()
                q, ids, scores = _search(
                    _matrix(asked.column("_v"), np.int64), own, asked.column("_floor").to_numpy(),
                    _matrix(held.column("_vec"), np.int64), held.column("_vid").to_numpy(),
                    held.column("_dist").to_numpy(), shared.value[held.column("_p")[0].as_py()], most, k)
                names, found = own[q], (ids, scores)
            return pa.table({"query_id": names, "vec_id": found[0], "score": found[1]})

        keys = ["_p", "_b", "_c"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
            block, "query_id long, vec_id long, score long")

    lowest = F.lit(int(np.iinfo(np.int64).min)).cast("long")
    queries = index.filter("_q")
    home = stored(searched(queries.select("_id", "_v", "_p", lowest.alias("_floor"))))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (home.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") == k)
           .select(F.col("query_id").alias("_qid"), F.col("score").alias("_kth")))
    waiting = (queries.join(kth, queries["_id"] == kth["_qid"], "left")
               .select("_id", "_v", F.col("_p").alias("_home"), F.coalesce("_kth", lowest).alias("_floor")))

    def others(batches):
        pivots = shared.value
        numbers = np.array(sorted(cells))
        lo, hi = (np.array([cells[p][x] for p in numbers]) for x in (1, 2))
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column("_v"), np.int64)
            far = _distances(np.column_stack([v.astype(float), np.zeros(len(v))]), pivots[numbers])
            gap = np.maximum(0, np.maximum(far - hi[None], lo[None] - far))
            bound = ((v.astype(float) ** 2).sum(axis=1)[:, None] + most - gap * gap) / 2 + _slack(most)
            floor = batch.column("_floor").to_numpy()
            home = batch.column("_home").to_numpy()
            row, col = np.nonzero((bound >= floor[:, None]) & (numbers[None] != home[:, None]))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(at), batch.column("_v").take(at),
                 pa.array(numbers[col].astype("i4")), batch.column("_floor").take(at)],
                names=["_id", "_v", "_p", "_floor"])

    rest = searched(stored(waiting.mapInArrow(others, "_id long, _v array<bigint>, _p int, _floor long")))
    return (home.union(rest).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


#: DuckDB SQL of the query over `embeddings`.
TOP_K_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
