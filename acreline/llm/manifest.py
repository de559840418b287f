"""Merkle manifest of a dataset: leaves of rows, a tree of eights for each language, one root.

Rows become leaves once; only digests move from there. Leaves are ranked within their language
by a range shuffle, and 4,096 in a row form a superblock, whose subtree is four levels high. A
superblock's own root comes from its leaves, and the roots form the leaves of the next round, so a
few rounds reach the language's root, and the languages' roots are ranked and reduced the same
way. Back down, leaves are cogrouped by superblock with the one row of outer nodes that they
share: the siblings from the superblock's root upwards. That task finishes the superblock's levels,
joins both parts of every leaf's proof and folds it to the root.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.llm.common import shuffle_partitions, stored

FAN = 8
#: Levels within a superblock.
HEIGHT = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """`-` for NULL, else the length in UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def tampered(id_col: Column) -> Column:
    """Rows whose id's decimal text has a crc32 that 3 divides; a NULL id has none."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def local_levels(n: int, height: int) -> int:
    """Levels of a superblock's subtree in a group of n: `height` of them unless the group ends below."""
    return min(height, levels_of(n))


def reduce_nodes(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from `nodes` on; runs of FAN hash to one node of the next level."""
    out = [nodes]
    for _ in range(levels):
        out.append([_hash("".join(out[-1][i:i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(left, right) of node `at`: what stands beside it in its run, level by level below the top."""
    out = []
    for level in tree[:-1]:
        lo = at - at % FAN
        out.append(("".join(level[lo:at]), "".join(level[at + 1:lo + FAN])))
        at //= FAN
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = _hash(left + node + right)
    return node


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add pos, the rank from 0 within the group by `order`, and n, the rows of the group.

    Rows are dealt by ranges of (group, order), so a group of any share lies in many tasks, and
    rows that are equal in all of it are parted by their number. Each range counts its own
    rows; the counts before it are joined back.
    """
    spark = df.sparkSession
    dealt = (df.withColumn("_row", F.monotonically_increasing_id())
             .repartitionByRange(shuffle_partitions(spark), group, *order, "_row"))
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_size"))
    by_range = Window.partitionBy(group).orderBy("_range")
    carry = sizes.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"),
        (F.sum("_size").over(by_range) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy(group)).alias("n"))
    here = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_row")) - 1
    return (dealt.withColumn("_here", here)
            .join(carry, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
            .withColumn("pos", F.col("_before") + F.col("_here"))
            .select(*[c for c in df.columns], "pos", "n"))


def _block(height: int) -> Column:
    return F.floor(F.col("pos") / FAN ** height).cast("long")


def block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """(g, pos, n, node) of the next round from such rows of one: the roots of superblocks."""
    def reduced(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        n = int(frame["n"].iloc[0])
        top = reduce_nodes(frame["node"].tolist(), local_levels(n, height))[-1][0]
        return pd.DataFrame({"g": [key[0]], "pos": [key[1]], "n": [-(-n // FAN ** height)], "node": [top]})

    rows = nodes.select("g", "pos", "n", "node", _block(height).alias("block"))
    return rows.groupBy("g", "block").applyInPandas(reduced, "g long, pos long, n long, node string")


_PATH = "array<struct<l: string, r: string>>"


def paths(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """(g, pos, path, root): of each node of a round all siblings up to the root.

    `outer` has (g, block, path, root) of the superblocks: the outer nodes that their nodes share.
    """
    def joined(key: tuple, frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = _proofs(frame, above, height)
        return pd.DataFrame({
            "g": frame["g"], "pos": frame["pos"], "root": above["root"].iloc[0],
            "path": [[{"l": left, "r": right} for left, right in own(at)] for at in frame["pos"]]})

    rows = nodes.select("g", "pos", "n", "node", _block(height).alias("block"))
    return rows.groupBy("g", "block").cogroup(outer.groupBy("g", "block")).applyInPandas(
        joined, f"g long, pos long, path {_PATH}, root string")


def _proofs(frame: pd.DataFrame, above: pd.DataFrame, height: int):
    """at -> the proof of the node at that position: through the superblock, then the outer nodes."""
    frame = frame.sort_values("pos")
    tree = reduce_nodes(frame["node"].tolist(), local_levels(int(frame["n"].iloc[0]), height))
    outer = [(p["l"], p["r"]) for p in above["path"].iloc[0]]
    return lambda at: siblings(tree, int(at) % FAN ** height) + outer


def outer_nodes(base: DataFrame, height: int, top: DataFrame | None = None) -> DataFrame:
    """(g, block, path, root) for the superblocks of `base`: rows (g, pos, n, node).

    Each round's superblock roots are the next round's nodes until every group is one block.
    `top` gives what stands above a group's root (g, path, root); without it, nothing.
    """
    rounds = [base]
    most = base.agg(F.max("n")).first()[0] or 0
    while most > FAN ** height:
        rounds.append(stored(block_roots(rounds[-1], height)))
        most = -(-most // FAN ** height)
    last = rounds[-1]
    if top is None:
        top = _roots_of(last, height).select("g", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"))
    outer = top.select("g", F.lit(0).cast("long").alias("block"), "path", "root")
    for nodes in reversed(rounds[1:]):
        outer = stored(paths(nodes, outer, height)).select("g", F.col("pos").alias("block"), "path", "root")
    return outer


def group_roots(base: DataFrame, height: int) -> DataFrame:
    """(g, node): the root of each group."""
    nodes, most = base, base.agg(F.max("n")).first()[0] or 0
    while most > FAN ** height:
        nodes = stored(block_roots(nodes, height))
        most = -(-most // FAN ** height)
    return _roots_of(nodes, height)


def _roots_of(nodes: DataFrame, height: int) -> DataFrame:
    """Of groups that are one superblock each."""
    return block_roots(nodes, height).select("g", "node")


def manifest(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             group_col: str = "lang", text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of docs.

    Leaves of a group ascend by id (NULL first), equal ids by their leaves; groups by their UTF-8
    bytes, NULL first as a group of its own. Rows equal in everything are leaves of their own.
    Tampering lower-cases A-Z in the text of a third of the rows: `folded_root` folds the
    tampered leaf with the original proof, and `verified` tells whether it still gives the root.
    NULL and empty fields differ (`-`, `0:`). A text of any length is hashed whole, in the JVM, and
    does not move. Other columns are not read. An empty table has no rows. Superblocks are `height`
    levels high, which changes no result.
    """
    text = F.col(text_col).cast("string")
    lowered = [F.translate(text, _UPPER, _LOWER) if f == text_col else F.col(f) for f in fields]
    original = leaf(*[F.col(f) for f in fields])
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("lang"), original.alias("node"),
        F.when(tampered(F.col(id_col)), leaf(*lowered)).otherwise(F.lit(None)).alias("changed"))
    leaves = ranked(rows, "lang", ["id", "node"])
    # Groups get a number each, which stands for the name from here on.
    names = ranked(leaves.select("lang").distinct().withColumn("all", F.lit(0)), "all", ["lang"])
    names = stored(names.select(F.col("lang").alias("_lang"), F.col("pos").alias("g"), F.col("n").alias("_groups")))
    base = stored(leaves.join(names, F.col("lang").eqNullSafe(F.col("_lang")))
                  .select(F.col("id").cast("string").alias("id"), "node", "changed", "g", "pos", "n"))
    subroots = stored(group_roots(base.select("g", "pos", "n", "node"), height))
    # The roots of the groups are the nodes of one more tree.
    crown = stored(subroots.join(names, "g").select(
        F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.col("_groups").alias("n"), "node"))
    above = paths(crown, outer_nodes(crown, height), height).select(F.col("pos").alias("g"), "path", "root")
    outer = outer_nodes(base.select("g", "pos", "n", "node"), height, above)
    outer = outer.join(subroots.withColumnRenamed("node", "subroot"), "g")
    id_type = docs.schema[id_col].dataType.simpleString()

    def finished(key: tuple, frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        proof = _proofs(frame, above, height)
        root, subroot = above["root"].iloc[0], above["subroot"].iloc[0]
        digests, folded = [], []
        for at, node, changed in zip(frame["pos"], frame["node"], frame["changed"]):
            path = proof(at)
            digests.append(_hash("".join(left + right for left, right in path)))
            folded.append(fold(node if changed is None else changed, path))
        return pd.DataFrame({"id": frame["id"], "leaf": frame["node"], "subroot": subroot, "root": root,
                             "proof_sha256": digests, "folded_root": folded, "verified": [f == root for f in folded]})

    whole = base.withColumn("block", _block(height)).groupBy("g", "block").cogroup(outer.groupBy("g", "block")).applyInPandas(
        finished, "id string, leaf string, subroot string, root string, proof_sha256 string, "
                  "folded_root string, verified boolean")
    # As text the ids pass pandas exactly, NULLs among them.
    return whole.select(F.col("id").cast(id_type).alias(id_col), *whole.columns[1:])


def _sql() -> str:
    """DuckDB: both trees level by level; eight levels hold 16 million rows a group, three 512 groups."""
    def of(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    steps = [f"""crc AS (SELECT list(x ORDER BY i) AS x FROM (SELECT i, list_reduce([i::BIGINT] || [0::BIGINT for _ in range(8)],
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i)))""",
             """d AS (SELECT *, coalesce(xor(list_reduce([4294967295] || [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')],
    lambda a, c: xor(a >> 8, x[(xor(a, c) & 255) + 1])), 4294967295) % 3 = 0, false) AS t FROM documents, crc)""",
             f"""leaves AS (SELECT doc_id, lang, {of('text')} AS leaf,
    CASE WHEN t THEN {of(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {of('text')} END AS shown FROM d)""",
             """a0 AS (SELECT doc_id, lang AS g, leaf AS node, shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves)""",
             "f0 AS (SELECT doc_id, g, pos AS leaf_pos, node AS leaf, pos, shown AS cur, '' AS path FROM a0)"]
    at = 0

    def tree(name: str, levels: int) -> None:
        nonlocal at
        for k in range(levels):
            steps.append(f"""{name}{k + 1} AS (SELECT g, pos // {FAN} AS pos, any_value((n + {FAN - 1}) // {FAN}) AS n,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node
    FROM {name}{k} GROUP BY g, pos // {FAN})""")
            sides = ", ".join(f"""coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // {FAN} ORDER BY pos
    ROWS BETWEEN {frame}), '') AS {side}""" for side, frame in (
                ("l", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("r", "1 FOLLOWING AND UNBOUNDED FOLLOWING")))
            steps.append(f"{name}s{k} AS (SELECT g, pos, n, {sides} FROM {name}{k})")
            steps.append(f"""f{at + 1} AS (SELECT f.* REPLACE (f.pos // {FAN} AS pos, path || l || r AS path,
    CASE WHEN n > 1 THEN sha256(l || cur || r) ELSE cur END AS cur)
    FROM f{at} AS f JOIN {name}s{k} AS s ON f.g IS NOT DISTINCT FROM s.g AND f.pos = s.pos)""")
            at += 1

    tree("a", 8)
    steps.append("""b0 AS (SELECT 0 AS g, g AS lang, node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n FROM a8)""")
    steps.append(f"""f{at + 1} AS (SELECT doc_id, leaf, node AS subroot, 0 AS g, b0.pos, cur, path
    FROM f{at} AS f JOIN b0 ON f.g IS NOT DISTINCT FROM b0.lang)""")
    at += 1
    tree("b", 3)
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, node AS root, sha256(path) AS proof_sha256, cur AS folded_root, cur = node AS verified
FROM f{at} JOIN b3 USING (g, pos)"""


MANIFEST_SQL = _sql()
