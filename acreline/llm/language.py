"""Language identification by the nearest of several centroids per language.

A text is the vector of its letter n-grams (one to three code points, words padded by a space,
case folded), hashed to a fixed number of dimensions, weighted by TF-IDF and normalised.
Document frequencies come from all documents that are learnt from. On a bounded sample of each
language spherical k-means finds centroids, so that different kinds of text in one language
have a centre each. A text gets the language of the centroid with the largest cosine, and is marked
as rejected where that centre lies further away than nearly all sampled texts of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.llm.common import stored

DIMENSIONS = 1 << 14
#: Code points taken at once; n-grams across a cut are kept.
PORTION = 1 << 18
#: Centroids are held in every task, so languages are a checked number.
MAX_LANGUAGES = 1_000
UNDETERMINED = "und"
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_LETTER: list[np.ndarray] = []


def held_out(id_col: str) -> Column:
    """Rows that are not learnt from: crc32 of the id as text leaves 2 by 4, or a NULL id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram stands in the whole text; None without any letter."""
    letter, total, any_letter = _letters(), np.zeros(DIMENSIONS, np.int64), False
    before = np.full(1, 32, np.uint32)
    for lo in range(0, len(text or ""), PORTION):
        points = np.frombuffer(text[lo:lo + PORTION].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(letter[points], points, np.uint32(32))
        any_letter = any_letter or bool((points != 32).any())
        last = [np.uint32(32)] if lo + PORTION >= len(text) else []
        points = np.concatenate([before, points, np.array(last, np.uint32)])
        # Runs of what is no letter are one space.
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        one = points * _MIX[0]
        two = (points[:-1] * _MIX[1]) ^ (one[1:] >> np.uint32(3))
        three = (two[:-1] * _MIX[2]) ^ (one[2:] >> np.uint32(7))
        # A portion begins with the points before it; n-grams of these alone are counted there.
        known = len(before)
        new = points[known:]
        for mix, grams in zip(_MIX, (one[known:][new != 32], two[known - 1:], three[max(known - 2, 0):])):
            bucket = ((grams ^ (grams >> np.uint32(15))) * mix) >> np.uint32(32 - 14)
            total += np.bincount(bucket, minlength=DIMENSIONS)
        before = points[-2:]
    return total if any_letter else None


@dataclass
class Model:
    """Languages with their centroids, one row each, and how near a text must come."""

    idf: np.ndarray
    languages: list[str]
    of: np.ndarray         # language number of each centroid
    centroids: np.ndarray  # dimensions x centroids
    nearest: np.ndarray    # cosine below which a centroid rejects


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, values) of the normalised TF-IDF vector."""
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    length = np.sqrt((values * values).sum())
    return at, values / (length if length else 1)


def statistics(labelled: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """(document frequencies, documents per language) over all rows (lang, text) with a letter."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(DIMENSIONS, np.int64), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    df += counts > 0
                    docs[lang] = docs.get(lang, 0) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(at) + list(docs), pa.string()), pa.array([*at.tolist(), *[-1] * len(docs)], pa.int32()),
             pa.array([*df[at].tolist(), *docs.values()], pa.int64())], names=["lang", "dimension", "n"])

    partial = labelled.select("lang", "text").mapInArrow(counted, "lang string, dimension int, n long")
    sums = stored(partial.groupBy("lang", "dimension").agg(F.sum("n").alias("n")))
    languages = sums.filter("dimension < 0").select("lang", "n").limit(MAX_LANGUAGES + 1).collect()
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    df = np.zeros(DIMENSIONS, np.int64)
    for r in sums.filter("dimension >= 0").collect():  # one row a dimension at most
        df[r["dimension"]] = r["n"]
    return df, {r["lang"]: r["n"] for r in languages}


def cluster(rows: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, cosines of rows and centroids): spherical k-means from far-apart starts."""
    centres = [rows[0]]
    near = rows @ rows[0]
    while len(centres) < clusters and near.min() < 1 - 1e-6:
        centres.append(rows[int(near.argmin())])
        near = np.maximum(near, rows @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-30), centres)
    return centres, rows @ centres.T


def train(labelled: DataFrame, clusters: int = 6, sample_docs: int = 1_000, reject: float = 0.005) -> Model:
    """A model from rows (id, lang, text); a language's centroids come from about `sample_docs` texts.

    The sample is drawn by a hash of id and row number, so groups of copies weigh as they do in the
    data. `reject` is the share of a centroid's own sampled texts that its threshold would reject.
    """
    spark = labelled.sparkSession
    df, docs = statistics(labelled)
    total = sum(docs.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    if not docs:
        return Model(idf, [], np.zeros(0, int), np.zeros((DIMENSIONS, 0), "f4"), np.zeros(0))
    rates = spark.createDataFrame([(k, min(1.0, 1.3 * sample_docs / n)) for k, n in docs.items()], "_lang string, _rate double")
    drawn = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    picked = (labelled.withColumn("_draw", drawn).join(F.broadcast(rates), F.col("lang") == F.col("_lang"))
              .filter(F.col("_draw") < F.col("_rate")).select("lang", "_draw", "text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, draw, gram_counts(t.as_py())) for lang, draw, t in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))]
            found = [(lang, draw, *weighted(c, idf)) for lang, draw, c in found if c is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2].astype("<i4").tobytes() for f in found], pa.binary()),
                 pa.array([f[3].astype("<f4").tobytes() for f in found], pa.binary())],
                names=["lang", "draw", "at", "values"])

    sampled = picked.mapInArrow(vectors, "lang string, draw double, at binary, values binary")
    order = Window.partitionBy("lang").orderBy("draw", "at")
    sampled = sampled.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample_docs)

    def fitted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n")
        rows = np.zeros((len(frame), DIMENSIONS), "f4")
        for i, (at, values) in enumerate(zip(frame["at"], frame["values"])):
            rows[i, np.frombuffer(at, "<i4")] = np.frombuffer(values, "<f4")
        centres, near = cluster(rows, clusters)
        own = near.argmax(axis=1)
        floor = [float(np.quantile(near[own == c, c], reject)) if (own == c).any() else 0.0 for c in range(len(centres))]
        return pd.DataFrame({"lang": key[0], "n": range(len(centres)), "floor": floor,
                             "centre": [c.astype("<f4").tobytes() for c in centres]})

    got = sampled.groupBy("lang").applyInPandas(fitted, "lang string, n int, floor double, centre binary").collect()
    got.sort(key=lambda r: (r["lang"].encode(), r["n"]))  # MAX_LANGUAGES * clusters rows at most
    languages = sorted({r["lang"] for r in got}, key=str.encode)
    return Model(idf, languages, np.array([languages.index(r["lang"]) for r in got]),
                 np.ascontiguousarray(np.stack([np.frombuffer(r["centre"], "<f4") for r in got]).T),
                 np.array([r["floor"] for r in got]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, margin, rejected), one row per row.

    `score` is the cosine to the nearest centroid (0 to 1), `margin` how far it lies above the best of
    any other language, `rejected` whether it is below what nearly all texts of that centroid reach.
    Equal cosines go to the language that is first by its bytes. A NULL text, one without a letter, and
    any text under a model without languages is `und` with score 0, and rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores, margins, rejected = [], [], [], []
            for text in batch.column(1):
                counts = gram_counts(text.as_py()) if m.languages else None
                if counts is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    margins.append(0.0)
                    rejected.append(True)
                    continue
                at, values = weighted(counts, m.idf)
                near = values @ m.centroids[at]
                best = int(near.argmax())
                others = near[m.of != m.of[best]]
                names.append(m.languages[m.of[best]])
                scores.append(min(max(float(near[best]), 0.0), 1.0))
                margins.append(float(near[best] - others.max()) if len(others) else scores[-1])
                rejected.append(bool(near[best] < m.nearest[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["id", "lang_pred", "score", "margin", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        judged, f"id {id_type}, lang_pred string, score double, margin double, rejected boolean").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
             clusters: int = 6, sample_docs: int = 1_000, reject: float = 0.005) -> DataFrame:
    """(id, held_out, lang_pred, score, margin, rejected): learn from the rows that are not held out.

    Rows with a NULL language or text, or a text without letters, are not learnt from; NULL ids are held out.
    Whole texts of any length are read. Repeated rows stay and get the same result. Other columns are not
    read. Without anything to learn from, all is `und`; an empty table has no rows.
    """
    labelled = (docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
                .select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                        F.col(text_col).cast("string").alias("text")))
    model = train(labelled, clusters, sample_docs, reject)
    found = predict(docs, model, id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "margin", "rejected")
