"""Resharding by minimum-cost flow.

From the bytes that old shards hold and the capacities of new ones, a minimum-cost flow says
how many bytes go from each old shard to each new one so that the fewest move. The flow is
carried out in blocks: a shard's rows hashed by text into a fixed number of parts, so copies
of a text stay together. Only block sizes go to the driver, at most shards x parts of them.
The rows then move: each is written whole into its new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import chunk_of, exclusive_sum, shuffle_partitions
from acreline.sources.extracts import run_path

Moves = dict[tuple[int, int], int]


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int]) -> Moves:
    """Bytes from old shard i to new shard j; staying costs nothing, moving 1 a byte.

    Successive shortest paths over old shards, new shards and the arcs already used backwards.
    The capacities must hold the supply.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    flow: Moves = {}
    left, room = list(supply), list(capacity)
    cost = lambda i, j: int(i != j)
    while any(left):
        # Bellman-Ford from all old shards that still hold bytes.
        old = [0 if n else None for n in left]
        new: list[int | None] = [None] * len(room)
        came: dict[tuple[str, int], int] = {}
        changed = True
        while changed:
            changed = False
            for i, d in enumerate(old):
                for j in range(len(room)) if d is not None else ():
                    if new[j] is None or d + cost(i, j) < new[j]:
                        new[j], came["new", j], changed = d + cost(i, j), i, True
            for (i, j), n in flow.items():
                if n and new[j] is not None and (old[i] is None or new[j] - cost(i, j) < old[i]):
                    old[i], came["old", i], changed = new[j] - cost(i, j), j, True
        j = min((j for j in range(len(room)) if room[j] and new[j] is not None), key=lambda j: (new[j], j))
        path, i = [], came["new", j]
        end = j
        path.append((i, j, 1))
        while ("old", i) in came:
            back = came["old", i]
            path.append((i, back, -1))
            i = came["new", back]
            path.append((i, back, 1))
        n = min([left[i], room[end], *(flow[a, b] for a, b, way in path if way < 0)])
        for a, b, way in path:
            flow[a, b] = flow.get((a, b), 0) + way * n
        left[i] -= n
        room[end] -= n
    return {k: n for k, n in flow.items() if n}


def place_blocks(blocks: dict[tuple[int, int], int], flow: Moves, capacity: Sequence[int]) -> dict[tuple[int, int], int]:
    """New shard of every block (old shard, part): large blocks first to where most is due.

    Blocks do not divide as a flow does; what is over afterwards is evened out by moving or
    exchanging single blocks between the fullest and the emptiest shard while that helps.
    """
    due, fill, where = dict(flow), [0] * len(capacity), {}
    for (i, part), n in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        j = max((j for j in range(len(capacity))), key=lambda j: (due.get((i, j), 0), i == j, capacity[j] - fill[j], -j))
        due[i, j] = due.get((i, j), 0) - n
        fill[j] += n
        where[i, part] = j
    over = lambda j: fill[j] - capacity[j]
    for _ in range(4 * len(blocks)):
        full, empty = (f(range(len(capacity)), key=lambda j: (over(j), j)) for f in (max, min))
        gap = over(full) - over(empty)
        mine = sorted((n, b) for b, n in blocks.items() if where[b] == full)
        theirs = sorted([(0, None), *((n, b) for b, n in blocks.items() if where[b] == empty)])
        best, k = None, len(theirs) - 1
        for n, b in reversed(mine):  # the difference nearest to half the gap
            while k > 0 and n - theirs[k][0] < gap // 2:
                k -= 1
            for t in theirs[k:k + 2]:
                d = n - t[0]
                if 0 < d < gap and (best is None or abs(gap - 2 * d) < best[0]):
                    best = (abs(gap - 2 * d), d, b, t[1])
        if best is None or best[0] >= gap:
            break
        _, d, b, other = best
        where[b] = empty
        if other is not None:
            where[other] = full
        fill[full] -= d
        fill[empty] += d
    return where


def reshard(docs: DataFrame, old_shards: int = 6, new_shards: int = 8, parts: int = 512,
            id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the new shards and return one row per document: (id, size, text_crc32, old_shard, shard, slot, moved).

    Whole rows are written below `path` (_shard=K/), by default a folder that goes when the driver ends, and
    the result is told from these files: size and checksum are those of the text that lies in the shard.

    Size is the text's UTF-8 bytes plus 1; a NULL text counts as empty. The old layout deals
    texts to `old_shards` by hash; the new one has equal capacities, and blocks move from one
    to the other by minimum-cost flow. Equal texts share a shard, unless they fill more than
    one: then they are dealt by document to several parts. Slots are gapless from 0 within a
    shard, by a pseudo-random chunk and then id. NULL ids and repeated rows are rows like
    others. No rows in: no rows out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measures = {"_size": (F.octet_length(text) + 1).cast("long"), "_h": F.xxhash64(text)}
    base = docs.select(F.col(id_col).alias("_id"), *[c.alias(n) for n, c in measures.items()])
    total = base.agg(F.sum("_size")).first()[0] or 0
    most = max(1, -(-total // new_shards))
    # At most new_shards groups of equal texts can hold more bytes than one shard.
    large = [(r["_h"], int(4 * r["n"] // most) + 1) for r in
             base.groupBy("_h").agg(F.sum("_size").alias("n")).filter(F.col("n") > most).collect()]
    split = F.lit(0)
    for h, n in large:
        split = F.when(F.col("_h") == h, F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")).otherwise(split)
    block = {"_old": F.pmod(F.xxhash64("_h", F.lit("shard")), F.lit(old_shards)).cast("int"),
             "_part": F.pmod(F.xxhash64("_h", split), F.lit(parts)).cast("int")}
    blocks = {(r[0], r[1]): r[2] for r in
              base.withColumns(block).groupBy("_old", "_part").agg(F.sum("_size")).collect()}
    supply = [sum(n for (i, _), n in blocks.items() if i == k) for k in range(old_shards)]
    capacity = [total // new_shards + (k < total % new_shards) for k in range(new_shards)]
    where = place_blocks(blocks, min_cost_flow(supply, capacity), capacity)
    # Bounded: one row for each old shard and part.
    table = spark.createDataFrame([(i, p, j) for (i, p), j in where.items()], "_o int, _p int, _shard int")
    # Whole rows from here on; their own columns travel in one, so that no name of theirs meets one of these.
    whole = docs.select(F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_row"), measures["_h"].alias("_h"))
    placed = (whole.withColumns(block)
              .join(F.broadcast(table), (F.col("_old") == F.col("_o")) & (F.col("_part") == F.col("_p")))
              .select("_id", "_row", "_h", "_old", "_shard"))
    slotted = exclusive_sum(placed, ["_shard"], chunk_of(spark, "_id", "_h"), ["_id", "_h"], F.lit(1), "_slot", few=True)
    files = slotted.select("_row", "_old", "_slot", "_shard")
    path = path or run_path(spark, "shards")
    files.write.mode("overwrite").partitionBy("_shard").parquet(path)
    # What is said of a row is told from what its new shard holds.
    held = spark.read.schema(files.schema).parquet(path)
    text = F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit(""))
    return held.select(F.col("_row").getField(id_col).alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.col("_old").alias("old_shard"),
                       F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
                       (F.col("_old") != F.col("_shard")).alias("moved"))


def affected(plan: DataFrame) -> list[int]:
    """New shards that gain rows, or lose some that they held under the same number."""
    moves = plan.filter("moved").select("old_shard", "shard").distinct().collect()
    return sorted({s for r in moves for s in r})


def rewrite(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Write the shards that change below `path` (shard=K/) and return their numbers.

    Files of other shards are not touched. Rows are matched by id, which must be unique here;
    each shard is written by several tasks.
    """
    spark = docs.sparkSession
    shards = affected(plan)
    rows = docs.join(plan.filter(F.col("shard").isin(shards)).select(id_col, "shard", "slot"), id_col)
    tasks = max(1, shuffle_partitions(spark) // max(1, len(shards)))
    (rows.repartition(F.col("shard"), F.pmod(F.col("slot"), F.lit(tasks))).write
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("shard").parquet(path))
    return shards
