"""Quality classifier by compression: which dictionary shortens a text more?

Two zstandard dictionaries are trained, one from texts labelled good, one from bad. A text is
compressed with each, in blocks of a fixed size so that a long text does not outgrow the
dictionaries; the difference of the two sizes over their sum, a number between -1 and 1, and
how far the text shrinks at all become a probability by logistic calibration on labelled texts
that the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import give_back

LEVEL = 3
BLOCK = 512
#: Rows scored and passed on at a time.
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    centre: tuple[float, ...] = (0.0, 0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0, 1.0)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)


class Scorer:
    """Both dictionaries, digested once per task."""

    def __init__(self, model: CompressionModel):
        self._model = model
        self._both = []
        for content in (model.good, model.bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self._both.append(zstandard.ZstdCompressor(
                dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float, float]:
        """(difference, ratio, ratio squared); the first is above 0 when good fits better."""
        blocks = [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self._both)
        ratio = min(good, bad) / (len(text) + 20 * len(blocks))
        return (bad - good) / (bad + good), ratio, ratio * ratio

    def score(self, text: bytes) -> float:
        m = self._model
        x = m.weights[-1] + sum(w * (f - c) / s for w, f, c, s in
                                zip(m.weights, self.features(text), m.centre, m.scale))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-3):
    """(centre, scale, weights) of a logistic regression, both classes weighing the same."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    if y.min() == y.max():
        return centre, scale, np.array([1.0] + [0.0] * x.shape[1])
    a = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    penalty = np.array([ridge] * x.shape[1] + [1e-9])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty),
                               a.T @ (weight * (p - y)) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, w


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 by 3; not NULL."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_bytes: int = 8192,
          dictionary_bytes: int = 112 << 10, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> CompressionModel:
    """Learn from at most `sample_docs` labelled texts of each class.

    The bound is part of the method: dictionaries have a fixed size. The sample is the texts
    with the smallest hashes of their ids, so it is the same in every run; of a sampled text
    up to `sample_bytes` are learnt (scoring reads whole texts). Two thirds of the sample
    build the dictionaries, the rest calibrates. Held-out rows, NULL labels and NULL ids are
    not used. Without both classes the score is 0.5 for all.
    """
    rows = (labels.filter(~held_out(id_col) & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"),
                    F.xxhash64(id_col).alias("_h")))
    picked = None
    for y in (0, 1):
        part = rows.filter(F.col("_y") == y).orderBy("_h", "_id").limit(sample_docs)
        picked = part if picked is None else picked.union(part)
    text = F.substring(F.col(text_col).cast("string").cast("binary"), 1, sample_bytes)
    sample = (docs.join(F.broadcast(picked), docs[id_col] == picked["_id"])
              .select("_y", "_h", text.alias("_t")).filter(F.length("_t") > 0).collect())
    sample.sort(key=lambda r: (r["_h"], bytes(r["_t"])))
    build = {0: [], 1: []}
    hold = []
    for k, r in enumerate(sample):
        if k % 3 == 2:
            hold.append((bytes(r["_t"]), r["_y"]))
        else:
            build[r["_y"]].append(bytes(r["_t"]))
    if not build[0] or not build[1]:
        return CompressionModel(b"", b"")
    good, bad = (_dictionary(build[y], dictionary_bytes) for y in (1, 0))
    scorer = Scorer(CompressionModel(good, bad))
    x = np.array([scorer.features(t) for t, _ in hold or [(build[1][0], 1)]])
    fitted = calibrate(x, np.array([y for _, y in hold or [(b"", 1)]]))
    return CompressionModel(good, bad, *(tuple(map(float, f)) for f in fitted))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; of very small samples, the texts themselves."""
    total = sum(map(len, texts))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:size]


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id",
          text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, score) for every whole text: the probability of label 1.

    With `keep` those columns are carried instead of the id alone, and the score is last. NULL
    counts as empty; an empty text gets the score of no evidence. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or [id_col]
    inner = [f"_k{i}" for i in range(len(keep))]
    carried = [F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)]
    at = keep.index(text_col) if text_col in keep else len(keep)
    if at == len(keep):
        carried.append(F.col(f"`{text_col}`").cast("string").alias("_t"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model.good else None
        for whole in batches:
            # A few rows at a time: the texts come back to Spark, which holds a batch outside its heap.
            for lo in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                texts = batch.column(at).cast(pa.binary())
                p = [scorer.score(t.as_py() or b"") if scorer else 0.5 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(inner)], pa.array(p, pa.float64())], names=[*inner, "_llm_score"])
        give_back()

    schema = ", ".join([f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(keep, inner)]
                       + ["_llm_score double"])
    return (docs.select(*carried).mapInArrow(scored, schema)
            .select(*[F.col(i).alias(c) for c, i in zip(keep, inner)], "_llm_score"))
