"""Packing: a non-negative least squares plan over the histogram of piece lengths.

Documents become token ids, each with an end id. A document longer than the window is cut
into full windows and one shorter piece; every other document stays whole. What remains is
to combine pieces into windows. Only the histogram (at most one count for each length up
to the window) goes to the driver: there, shallow combinations of two or three lengths that
fill a window exactly are enumerated, repeat counts solved by non-negative least squares and
rounded within the histogram, and the lengths left over are packed largest first. The plan
says how many pieces of each length go where; pieces take their places by a distributed rank
within their length. Token ids are never shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import exclusive_sum, shuffle_partitions, stored
from acreline.llm.encoding import GROUP_BYTES, WordEncoder, encoder, read_tokenizer, task_encoder

#: Third lengths tried with each first length when triples are enumerated. Others are left
#: to the pass over residuals, which takes all lengths.
TRIPLE_PARTNERS = 48
NNLS_ROUNDS = 300


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int,
               id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
               group_bytes: int = GROUP_BYTES, task_words: int | None = None) -> DataFrame:
    """Pieces of at most `window` ids: (id, start, length, ids_crc32, doc_tokens[, ids]).

    A NULL or empty text is the end id alone.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    id_type = docs.schema[id_col].dataType.simpleString()
    end, step = np.asarray([end_id], dtype="<u4").tobytes(), 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer.value, task_words) if task_words else nullcontext(encoder(tokenizer.value)) as encode:
            for batch in batches:
                yield pieces(encode, batch)

    def pieces(encode: WordEncoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, length, crc, total, ids = [], [], [], [], [], []
        texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
        for i, parts in enumerate(encode.texts(texts, group_bytes)):
            raw = b"".join([*parts, end])
            for at in range(0, len(raw), step):
                piece = raw[at:at + step]
                row.append(i)
                start.append(at // 4)
                length.append(len(piece) // 4)
                crc.append(zlib.crc32(piece))
                total.append(len(raw) // 4)
                if with_ids:
                    ids.append(np.frombuffer(piece, "<u4").astype("i4"))
        out = [batch.column(0).take(pa.array(row, pa.int64())),
               *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(out, names=names)

    schema = (f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
              + ", ids array<int>" * with_ids)
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(cut, schema).withColumnRenamed("id", id_col))


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Shallow combinations that fill the window: rows of three lengths, 0 for none."""
    present = np.flatnonzero(counts[:window])
    here = np.zeros(window + 1, dtype=bool)
    here[present] = True
    pairs = [(a, window - a, 0) for a in present.tolist() if a >= window - a and here[window - a]]
    common = present[np.argsort(-counts[present], kind="stable")[:TRIPLE_PARTNERS]]
    a, b = np.meshgrid(present, common, indexing="ij")
    c = window - a - b
    ok = (c > 0) & here[np.clip(c, 0, window)]
    triples = np.stack([a[ok], b[ok], c[ok]], axis=1)
    found = np.concatenate([np.array(pairs, dtype=int).reshape(-1, 3), triples.reshape(-1, 3)])
    return np.unique(-np.sort(-found, axis=1), axis=0)


def nnls_repeats(combos: np.ndarray, counts: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of least |A x - counts|, by multiplicative updates."""
    if not len(combos):
        return np.zeros(0)
    size = len(counts)
    wanted = counts.astype(float)
    wanted[0] = 0
    up = wanted[combos].sum(axis=1)
    x = np.full(len(combos), wanted.sum() / max(1, 3 * len(combos)))
    for _ in range(rounds):
        made = np.zeros(size)
        for k in range(3):
            made += np.bincount(combos[:, k], weights=x, minlength=size)
        made[0] = 0
        x *= up / np.maximum(made[combos].sum(axis=1), 1e-12)
    return x


def plan(counts: np.ndarray, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, pieces)] and how many sequences follow each.

    Every piece of the histogram `counts` (by length, 0 unused) is placed exactly once.
    """
    left = counts.astype(np.int64).copy()
    patterns = []
    if left[window]:
        patterns.append(([(window, 1)], int(left[window])))
        left[window] = 0
    combos = combinations(left, window)
    solved = nnls_repeats(combos, left)
    for i in np.argsort(-solved, kind="stable"):
        lengths, uses = np.unique(combos[i][combos[i] > 0], return_counts=True)
        n = min(int(solved[i] + 0.5), int((left[lengths] // uses).min()))
        if n > 0:
            patterns.append((list(zip(lengths.tolist(), uses.tolist())), n))
            left[lengths] -= n * uses
    present = np.flatnonzero(left).tolist()
    while present:
        space, pattern, top = window, [], len(present)
        while space and top:
            top = min(top, bisect_right(present, space))
            if not top:
                break
            length = present[top - 1]
            uses = min(space // length, int(left[length]))
            pattern.append((length, uses))
            space -= uses * length
            top -= 1
        n = min(int(left[length]) // uses for length, uses in pattern)
        patterns.append((pattern, n))
        for length, uses in pattern:
            left[length] -= n * uses
        present = [length for length in present if left[length]]
    return patterns


def _places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks of one length that share a pattern, sorted by (length, first rank)."""
    rows, used, sequence = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length, uses in pattern:
            rows.append((length, used.get(length, 0), sequence, uses, offset))
            used[length] = used.get(length, 0) + n * uses
            offset += length * uses
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "uses", "offset"), table.T))


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
         group_bytes: int = GROUP_BYTES, task_words: int | None = None) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Every id lies in exactly one piece; the pieces of a sequence are gapless from offset 0
    and hold at most `window` ids. NULL and empty texts are packed as their end id. Repeated
    rows are packed once each; NULL ids stay NULL. No rows in: no rows out. Other columns are
    not read. `with_ids` carries the ids themselves (see `sequences`). Texts are encoded `group_bytes`
    at a time: fewer bytes need less memory and more time. With `task_words` every task has an encoder of
    its own, which remembers so many words and goes with it; else a worker keeps one for its later tasks.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_path, window, end_id, id_col, text_col, with_ids, group_bytes, task_words))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():
        histogram[length] = n
    places = spark.sparkContext.broadcast(_places(plan(histogram, window)))

    # A length with many pieces is dealt to several chunks, so that no task ranks them all.
    most = max(256, int(histogram.sum()) // (4 * shuffle_partitions(spark)) + 1)
    chunks = {int(n): int(-(-histogram[n] // most)) for n in np.flatnonzero(histogram > most)}
    parts = F.lit(1)
    if chunks:
        table = F.create_map(*[F.lit(x) for pair in chunks.items() for x in pair])
        parts = F.coalesce(table[F.col("length").cast("int")], F.lit(1))
    ranked = exclusive_sum(pieces, ["length"], F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), parts),
                           [id_col, "start", "ids_crc32"], F.lit(1), "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        span = 1 << 44
        first = p["length"] * span + p["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, length * span + rank, side="right") - 1
            inside = rank - p["rank"][at]
            sequence = p["sequence"][at] + inside // p["uses"][at]
            offset = p["offset"][at] + inside % p["uses"][at] * length
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
                       + ["sequence_id long", "offset long"])
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Training rows from `pack(..., with_ids=True)`: (sequence_id, input_ids, starts)."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(pieces.alias("_p"))
            .select("sequence_id", F.flatten(F.col("_p.ids")).alias("input_ids"),
                    F.col("_p.offset").alias("starts")))
