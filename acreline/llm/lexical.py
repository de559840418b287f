"""Ranked lexical search over impact vectors in buckets of falling length, exact in integers.

A document is the vector of its impacts on the terms that the queries use, a query the vector
of its terms' counts; a score is their inner product. Documents are dealt by the length of
their vectors, longest first. In a bucket of like lengths a query is done when its length times
the bucket's greatest falls below the score that it already has k times (Cauchy-Schwarz), and
so are all shorter ones after it. Inside a bucket the query's heaviest terms are multiplied
out; the rest is bounded by the lengths of what remains of both vectors. What survives is
scored exactly in 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreline.llm.common import shuffle_partitions, stored

#: Texts are taken in portions of about so many bytes, cut where a term ends.
PORTION_BYTES = 4 << 20
#: Queries are searched together until they hold so many terms.
BLOCK_TERMS = 1 << 16
#: Documents in one bucket of a task, fewer where a block has so many terms that the cells would exceed BUCKET_CELLS.
BUCKET = 1024
BUCKET_CELLS = 1 << 23
#: Coordinates multiplied out before the rest is bounded.
FOCUS = 6

# Terms are runs of ASCII letters and digits and of all that is not ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, A-Z lower-cased, portion by portion."""
    folded, lo = (text or b"").translate(_FOLD), 0
    while lo < len(folded):
        hi = lo + PORTION_BYTES
        cut = folded.find(b" ", hi) if hi < len(folded) else -1
        hi = len(folded) if cut < 0 else cut
        yield folded[lo:hi].split()
        lo = hi


@dataclass
class Queries:
    """A block of queries over its own numbering of terms."""

    vocabulary: dict[bytes, int]
    ids: list[np.ndarray]     # of each query: its terms
    counts: list[np.ndarray]  # and how often it has each


def number_terms(texts: list[bytes | None]) -> Queries:
    vocabulary, ids, counts = {}, [], []
    for text in texts:
        found = Counter(t for part in terms(text) for t in part)
        ids.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in found), np.int64, len(found)))
        counts.append(np.fromiter(found.values(), np.int64, len(found)))
    return Queries(vocabulary, ids, counts)


def term_counts(docs: DataFrame, queries) -> DataFrame:
    """(id, n, ids, tfs): a text's number of terms, and those of the queries that it holds.

    docs has the columns id and text; `queries` is a broadcast Queries.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = queries.value.vocabulary
        get = vocabulary.get
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                total, parts = 0, [np.empty((0, 2), np.int64)]
                for part in terms(text.as_py()):
                    total += len(part)
                    at = np.fromiter(map(get, part, repeat(-1)), np.int64, len(part))
                    parts.append(np.column_stack(np.unique(at[at >= 0], return_counts=True)))
                found = np.concatenate(parts)
                held, where = np.unique(found[:, 0], return_inverse=True)
                n.append(total)
                ids.append(held.astype("<i4").tobytes())
                tfs.append(np.bincount(where, found[:, 1], len(held)).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())],
                names=["id", "n", "ids", "tfs"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(counted, f"id {id_type}, n long, ids binary, tfs binary")


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """In how many rows each term stands."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total[np.frombuffer(ids.as_py(), "<i4")] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    rows = held.select("ids").mapInArrow(summed, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in rows.toLocalIterator():
        df[r["term"]] = r["df"]
    return df


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: int, documents: int, length: int) -> np.ndarray:
    """What each term adds for a weight of one; longer documents gain less."""
    m = 100 - 75 + (75 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Search:
    """The k best of the documents that a task has met so far, for each query of a block.

    `floors` are scores of which every query is known to have k documents.
    """

    def __init__(self, queries: Queries, w: np.ndarray, k: int, floors: np.ndarray):
        self.q, self.w, self.k, self.floors = queries, w, k, floors.copy()
        self.best = [[] for _ in queries.ids]  # of (-score, no id, id)
        self.open = list(range(len(queries.ids)))
        self.focus = []
        for ids, counts in zip(queries.ids, queries.counts):
            heavy = np.argsort(-(counts * w[ids]), kind="stable")[:FOCUS]
            rest = np.delete(counts, heavy).astype(float)
            self.focus.append((ids[heavy], counts[heavy].astype(float), math.sqrt((rest * rest).sum())))
        self.lengths = [math.sqrt((c.astype(float) ** 2).sum()) for c in queries.counts]
        self.columns = [np.flatnonzero(w[ids] > 0) for ids in queries.ids]

    def bucket(self, names: list, vectors: list[tuple[np.ndarray, np.ndarray]], norms: np.ndarray) -> None:
        """Documents by falling length; a vector is (terms, impacts). Earlier buckets were no shorter."""
        if not self.open:
            return
        greatest = norms[0]
        # A query whose k-th score lies above what this length allows is done for good.
        self.open = [i for i in self.open if self.lengths[i] * greatest * (1 + 1e-9) >= self.floors[i]]
        used = np.unique(np.concatenate([self.q.ids[i] for i in self.open])) if self.open else np.empty(0, np.int64)
        if not len(used):
            return
        where = np.full(len(self.w), -1)
        where[used] = np.arange(len(used))
        dense = np.zeros((len(used), len(names)), np.int64)
        for j, (ids, values) in enumerate(vectors):
            at = where[ids]
            inside = at >= 0
            dense[at[inside], j] = values[inside]
        square = norms * norms
        for i in self.open:
            ids, counts, rest = self.focus[i]
            own = dense[where[ids]].astype(float)
            left = np.sqrt(np.maximum(square - (own * own).sum(axis=0), 0))
            bound = counts @ own + rest * left
            alive = np.flatnonzero(bound * (1 + 1e-9) + 1 >= max(self.floors[i], 1))
            if not len(alive):
                continue
            scores = self.q.counts[i] @ dense[np.ix_(where[self.q.ids[i]], alive)]
            floor = max(self.floors[i], 1)
            new = [(-int(scores[j]), names[alive[j]] is None, names[alive[j]])
                   for j in np.flatnonzero(scores >= floor).tolist()]
            if new:
                self.best[i] = sorted(self.best[i] + new, key=_order)[:self.k]
                if len(self.best[i]) == self.k:
                    self.floors[i] = max(self.floors[i], -self.best[i][-1][0])

    def rows(self) -> Iterator[tuple[int, int, object]]:
        for i, found in enumerate(self.best):
            for score, _, name in found:
                yield i, -score, name


def _order(x: tuple) -> tuple:
    return x[0], x[1], 0 if x[1] else x[2]


def _searched(ranged: DataFrame, shared, k: int, floors: np.ndarray, first_only: bool) -> DataFrame:
    """(q, score, id): each task's k best, of its first bucket or of all."""
    id_type = ranged.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = shared.value
        search, names, vectors, norms = Search(queries, w, k, floors), [], [], []
        size, kind = max(1, min(BUCKET, BUCKET_CELLS // len(w))), pa.null()

        def flush():
            search.bucket(names, vectors, np.array(norms))
            for x in (names, vectors, norms):
                x.clear()

        done = False
        for batch in batches:
            kind = batch.column(0).type
            if done or not search.open:
                continue
            ids, impact = batch.column(2), batch.column(3)
            for j, (name, norm) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                names.append(name)
                norms.append(norm)
                vectors.append((np.frombuffer(ids[j].as_py(), "<i4"), np.frombuffer(impact[j].as_py(), "<i8")))
                if len(names) == size:
                    flush()
                    if first_only:
                        done = True
                        break
        if names:
            flush()
        rows = list(search.rows())
        if not rows:
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], kind)], names=["q", "score", "id"])

    return ranged.mapInArrow(run, f"q int, score long, id {id_type}")


def _search_block(docs: DataFrame, texts: list[bytes | None], k: int) -> DataFrame | None:
    """(q, rank, score, id) for one block of queries; None if no document can score."""
    spark = docs.sparkSession
    queries = number_terms(texts)
    if not queries.vocabulary:
        return None
    counts = stored(term_counts(docs, spark.sparkContext.broadcast(queries)))
    documents, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counts.filter(F.length("ids") > 0)
    w = weights(document_frequencies(held, len(queries.vocabulary)), documents)
    shared = spark.sparkContext.broadcast((queries, w))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value[1]
        for batch in batches:
            norms, values = [], []
            for n, ids, tfs in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                at = np.frombuffer(ids.as_py(), "<i4")
                value = w[at] * impacts(np.frombuffer(tfs.as_py(), "<i8"), n, documents, length)
                norms.append(math.sqrt((value.astype(float) ** 2).sum()))
                values.append(value.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norms, pa.float64()), batch.column(2), pa.array(values, pa.binary())],
                names=["id", "norm", "ids", "impacts"])

    id_type = docs.schema["id"].dataType.simpleString()
    long = held.mapInArrow(measured, f"id {id_type}, norm double, ids binary, impacts binary").filter("norm > 0")
    # Copies are equally long, so their ids part them.
    ranged = stored(long.repartitionByRange(shuffle_partitions(spark), F.desc("norm"), F.xxhash64("id"))
                    .sortWithinPartitions(F.desc("norm")))
    # The first bucket of every task gives each query a score that k documents reach.
    nothing = np.zeros(len(texts), np.int64)
    tops = _best(_searched(ranged, shared, k, nothing, True), k).filter(F.col("rank") == k).select("q", "score")
    floors = nothing.copy()
    for r in tops.toLocalIterator():
        floors[r["q"]] = r["score"]
    return _best(_searched(ranged, shared, k, floors, False), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the k best documents with a score above 0 for every item.

    Equal scores rank by ascending id, NULL ids last. NULL, empty and blank texts have no
    terms: as items they have no rows, as documents they do not count. Every row counts as a
    document of its own, so copies and repeated ids take a rank each; every item row gets a
    list of its own. Texts of any length are read whole. Other columns are not read. The
    statistics cover all documents. Items are searched in blocks that hold BLOCK_TERMS terms
    at most, or one item, and each block reads the documents once; only a block's items are in a
    task's memory. If one of the tables is empty, the result is.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    item_type, id_type = asked.schema["item"].dataType.simpleString(), base.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item {item_type}, rank int, id {id_type}, score long")

    def blocks():
        block, size = [], 0
        for r in asked.toLocalIterator():
            text = None if r["text"] is None else bytes(r["text"])
            n = sum(map(len, terms(text)))
            if block and size + n > BLOCK_TERMS:
                yield block
                block, size = [], 0
            block.append((r["item"], text))
            size += n
        if block:
            yield block

    for block in blocks():
        found = _search_block(base, [text for _, text in block], k)
        if found is not None:
            names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"n int, item {item_type}")
            out = out.unionByName(found.join(names, found["q"] == names["n"]).select("item", "rank", "id", "score"))
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


#: DuckDB: the same by the definition.
SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT r, doc_id, coalesce(len(t), 0)::BIGINT AS n FROM d),
total AS (SELECT count(*) FILTER (n > 0)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
q AS (SELECT item_id, t, count(*)::BIGINT AS k FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS t FROM d)
       WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * n * docs) // length) AS m FROM n, total),
s AS (SELECT item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 10
"""
