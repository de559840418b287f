"""Mixing sources to target weights by blocks of words.

The words of a source, document after document, form one stream that is packed into blocks
of a fixed length. From each source's target follows how many block slots the mix has for it;
every output shard draws how many of its slots each source fills (multinomial), a slot's number is
mapped to a block through the source's own pseudo-random permutation of its block indices (one
for each pass over the source), and blocks are joined by index. Only totals per source go to the
driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import SPACE, WORD, chunk_of, exclusive_sum, shuffle_partitions, stored

SLOTS_AT_ONCE = 1 << 16
ROWS_AT_ONCE = 256
_WORD_AND_SPACE = re.compile(f"{WORD}(?:{SPACE})?".encode())


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight; none above `most` times its size, the excess shared again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in sorted(open_))
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        open_ -= over
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of 0..size-1 for each element: a Feistel network with cycle walking."""
    index, size = index.astype(np.uint64), size.astype(np.uint64)
    bits = np.zeros(len(index), dtype=np.uint64)
    for b in range(32):
        bits += (np.uint64(1) << np.uint64(2 * b)) < size
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def rounds(x, bits, mask, key):
        a, b = x >> bits, x & mask
        for r in range(6):
            h = b * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(r * 0x632BE59B)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h ^ (h >> np.uint64(29))) & mask)
        return (a << bits) | b

    with np.errstate(over="ignore"):
        out = rounds(index, bits, mask, key)
        todo = np.flatnonzero(out >= size)
        while len(todo):
            out[todo] = rounds(out[todo], bits[todo], mask[todo], key[todo])
            todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little")


def place(sized: DataFrame, source_col: str, weights, share, most):
    """(rows, sources): rows with _source, _source_size and _target joined on.

    `sources` lists (number, name, size, target) by code point of the name, NULL last; the
    weights repeat over them. It has one entry for each source and is kept on the driver.
    """
    spark = sized.sparkSession
    found = sized.groupBy(source_col).agg(F.sum("_size")).collect()
    found.sort(key=lambda r: (r[0] is None, "" if r[0] is None else str(r[0])))
    sizes = [r[1] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    sources = [(i, r[0], r[1], t) for i, (r, t) in enumerate(zip(found, wanted))]
    kind = sized.schema[source_col].dataType.simpleString()
    names = spark.createDataFrame(sources, f"_source int, _name {kind}, _source_size long, _target double")
    return sized.join(names, sized[source_col].eqNullSafe(names["_name"])).drop("_name"), sources


def deal(counts: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """(shards x sources) slots: each shard draws its share of all slots from the sources.

    A draw is multinomial by what the sources have in all; what a source has no more of is drawn from the
    others, and the last shard takes what is left, so that the columns sum up to `counts`.
    """
    left = np.array(counts, np.int64)
    rng = np.random.default_rng(_seed(seed, "shards"))
    out = np.zeros((shards, len(left)), np.int64)
    for shard in range(shards - 1):
        need = int(left.sum()) // (shards - shard)
        while need:
            share = np.where(left > 0, np.array(counts, float), 0)
            drawn = np.minimum(rng.multinomial(need, share / share.sum()), left)
            out[shard] += drawn
            left -= drawn
            need -= int(drawn.sum())
    out[shards - 1] = left
    return out


def slots(spark, sources, block: int, shards: int, seed: int) -> DataFrame:
    """(_source, _shard, _block): one row for each slot of the mix.

    A source of B blocks gets round(target / mean block) slots, which the output shards draw.
    A source's slots are numbered through the shards; slot s is block permutation(s mod B) of
    pass s div B.
    """
    blocks = [-(-size // block) for _, _, size, _ in sources]
    counts = [min(round(target * b / size), 10 ** 15) if size else 0
              for b, (_, _, size, target) in zip(blocks, sources)]
    ends = np.cumsum(deal(counts, shards, seed), axis=0)
    runs = []
    for (i, name, _, _), b, end in zip(sources, blocks, ends.T.tolist()):
        runs += [(i, shard, lo, hi, b, _seed(seed, "order", name) >> 1)
                 for shard, (lo, hi) in enumerate(zip([0, *end], end)) if hi > lo]
    table = spark.createDataFrame(
        runs, "_source int, _shard int, lo long, hi long, blocks long, key long")
    # Few rows become many, so adaptive execution must not put them into one task.
    pieces = (table.withColumn("lo", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(SLOTS_AT_ONCE))))
              .withColumn("hi", F.least("hi", F.col("lo") + SLOTS_AT_ONCE))
              .repartition(shuffle_partitions(spark), "_source", "_shard", "lo"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slot = np.arange(r["lo"], r["hi"])
                key = np.uint64(r["key"]) + (slot // r["blocks"]).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
                at = permuted(slot % r["blocks"], np.full(len(slot), r["blocks"]), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), r["_source"], "i4")),
                     pa.array(np.full(len(slot), r["_shard"], "i4")), pa.array(at)],
                    names=["_source", "_shard", "_block"])

    return pieces.mapInArrow(numbered, "_source int, _shard int, _block long")


def _with_blocks(rows: DataFrame, taken: DataFrame, block: int) -> DataFrame:
    """Rows (_source, _start, _size) joined by index to the blocks that the mix takes of them.

    Gives (_source, _start, _at, _words, _times, _first): a run of words from word `_at` of the document, how
    often it is taken, and the first shard that takes it.
    """
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_size") - 1) / block)
    parts = (rows.filter("_size > 0").select("_source", "_start", "_size", F.explode(
        F.sequence(first, last)).alias("_block")))
    lo = F.greatest(F.col("_start"), F.col("_block") * block)
    hi = F.least(F.col("_start") + F.col("_size"), (F.col("_block") + 1) * block)
    parts = parts.select("_source", "_block", "_start", (lo - F.col("_start")).alias("_at"),
                         (hi - lo).alias("_words"))
    times = taken.groupBy("_source", "_block").agg(F.count("*").alias("_times"), F.min("_shard").alias("_first"))
    # Both sides grow with the corpus; the slots come from a small table, so their size is
    # underestimated and must not decide for a broadcast.
    return parts.join(times.hint("merge"), ["_source", "_block"])


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2,
        block: int = 32, shards: int = 64, seed: int = 42, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: (id, size, source_size, target, taken, shard), in words.

    `taken` counts what the mix takes of the document, repeats included: at most ceil(most)
    times its size. Sources by code point, NULL as a source of its own at the end, have the
    given weights, repeating, and share `share` times all words; a target stops at `most`
    times its source, the excess goes to the others. A source's sum of `taken` differs from
    its target by about a block at most. `shard` is the first output shard that holds words of the
    document, NULL if none does. NULL and blank texts have size and taken 0. Repeated
    rows count each; NULL ids stay. Other columns are not read. The same input gives the same.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_from"),
                       F.col(text_col).cast("string").alias("_text"))
    sized = stored(base.select("_id", "_from", F.xxhash64("_text").alias("_h"), F.coalesce(
        F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size")))
    rows, sources = place(sized, "_from", weights, share, most)
    rows = exclusive_sum(rows, ["_source"], chunk_of(spark, "_id", "_h"), ["_id", "_h", "_size"],
                         "_size", "_start")
    taken = _with_blocks(rows, slots(spark, sources, block, shards, seed), block)
    sums = taken.groupBy("_source", "_start").agg(
        F.sum(F.col("_words") * F.col("_times")).alias("_taken"), F.min("_first").alias("_first"))
    sums = sums.select(F.col("_source").alias("_s"), F.col("_start").alias("_b"), "_taken", "_first")
    joined = rows.join(sums, (F.col("_size") > 0) & (rows["_source"] == sums["_s"])
                       & (rows["_start"] == sums["_b"]), "left")
    return joined.select(F.col("_id").alias(id_col), F.col("_size").alias("size"),
                         F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                         F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.col("_first").alias("shard"))


def mixed_texts(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                most: float = 2, block: int = 32, shards: int = 64, seed: int = 42,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: `docs` columns, the text cut to the blocks that the mix takes.

    A document with blocks that are taken twice has a second row for these. Words keep the
    white space after them. Documents of which nothing is taken have no row. Sources, targets
    and the cases of `mix` hold here.
    """
    spark = docs.sparkSession
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    name = dict(zip(docs.columns, inner))
    base = docs.toDF(*inner)
    # A row's key: two hashes of all its columns, NULLs told apart. Streams and runs are made of keys and
    # sizes; the rows themselves move once, to meet their runs.
    marks = [x for c in inner for x in (F.col(c), F.col(c).isNull())]
    base = base.withColumns({"_k": F.xxhash64(*marks), "_j": F.xxhash64(F.lit(seed), *marks)})
    sized = stored(base.select("_k", "_j", F.col(name[id_col]).alias("_id"), F.xxhash64(
        F.col(name[text_col]).cast("string")).alias("_h"), F.col(name[source_col]).alias("_from"), F.coalesce(F.regexp_count(
        F.col(name[text_col]).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("_size")))
    rows, sources = place(sized, "_from", weights, share, most)
    rows = stored(exclusive_sum(rows.filter("_size > 0"), ["_source"], chunk_of(spark, "_id", "_h"),
                                ["_id", "_h", "_size", "_k", "_j"], "_size", "_start"))
    taken = _with_blocks(rows, slots(spark, sources, block, shards, seed), block)
    runs = taken.groupBy("_source", "_start").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_words", "_times"))).alias("_runs"))
    runs = rows.join(runs, ["_source", "_start"]).select("_k", "_j", "_runs")
    # Equal rows are one row here, and each has runs of its own.
    once = base.groupBy("_k", "_j").agg(F.first(F.struct(*inner)).alias("_row"))
    joined = once.join(runs.hint("merge"), ["_k", "_j"]).select(
        *[F.col(f"_row.{c}").alias(c) for c in inner], F.col(f"_row.{name[text_col]}").cast("string").alias("_text"), "_runs")
    position = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A few rows at a time: lists of words and runs take many times the text's bytes.
            for lo in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                row, new = [], []
                for i, (text, runs) in enumerate(zip(batch.column(len(inner)), batch.column(len(inner) + 1))):
                    words, runs = _WORD_AND_SPACE.findall(text.as_py().encode()), runs.as_py()
                    for nth in range(1, max(r["_times"] for r in runs) + 1):
                        row.append(i)
                        new.append(b"".join(w for r in runs if r["_times"] >= nth
                                            for w in words[r["_at"]:r["_at"] + r["_words"]]))
                at = pa.array(row, pa.int64())
                columns = [batch.column(k).take(at) for k in range(len(inner))]
                columns[position] = pa.array(new, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=inner)

    schema = ", ".join(f"{i} {'string' if k == position else docs.schema[k].dataType.simpleString()}"
                       for k, i in enumerate(inner))
    made = joined.mapInArrow(cut, schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])
