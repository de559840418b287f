"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of
either. So every distinct fingerprint emits all variants within half the radius, variants
are shuffled, and fingerprints that meet in one are at most 2r bits apart. Equal fingerprints
are folded into one before that, so copies cost nothing, and a variant can meet only as many
distinct fingerprints as its own ball holds (65 for radius 2), whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.llm.common import stored

SEED = 42
BITS = 64
_SHINGLES_AT_ONCE = 1 << 14


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, width))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; all words if there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    count = max(1, len(words) - width + 1)
    if len(words) <= width:
        shingles = iter((joined,))
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:count - 1])).tolist()
        shingles = map(joined.__getitem__, map(slice, starts, (ends[width - 1:] - 1).tolist()))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    return np.fromiter(hashes, dtype="<u8", count=count)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
        block = hashes[at:at + _SHINGLES_AT_ONCE]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signature(text: bytes | None, width: int, words: int) -> list[int]:
    """`words` independent 64-bit SimHashes of the set of shingles, from remixed hashes, then its size."""
    hashes, out = np.unique(shingle_hashes(text, width)), []
    for k in range(words):
        mixed = (hashes ^ np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(mixed ^ (mixed >> np.uint64(29))))
    return [*out, len(hashes)]


def simhash(docs: DataFrame, width: int = 5, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit integer."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), dtype="<u8",
                              count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view("<i8"))], names=["id", "fp"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(hashed, f"id {id_type}, fp long").withColumnRenamed("id", id_col))


def ball_masks(half: int) -> list[int]:
    """All masks of at most `half` bits, as signed integers."""
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints, enough to join all that link.

    `fps` has one row per distinct `fp`. Fingerprints that share a variant are all within
    `radius` of one another; each is tied to the smallest of them, and the distance of each
    edge is verified.
    """
    if radius % 2:
        raise ValueError("the ball is half the radius; give an even radius")
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(radius // 2)])
    variants = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m)))
                          .alias("variant"))
    met = (variants.groupBy("variant").agg(F.collect_list("fp").alias("fps"))
           .filter(F.size("fps") > 1)
           .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")))
    return met.filter((F.col("a") < F.col("b")) & (distance("a", "b") <= radius)).distinct()


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


#: Edges that one task takes in a round; so many and fewer need no exchange.
EDGES_AT_ONCE = 1 << 17


def components(edges: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    Each round ties every node's neighbours to the smallest of them, first the larger ones,
    then all (alternating large and small stars), until no edge changes. The number of rounds
    grows with the logarithm of the longest chain; each is cut off by a checkpoint. Nodes with
    very many neighbours are only ever aggregated by `min`, so no neighbour list is gathered.
    A round's tasks follow the number of its edges, which mostly falls fast.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    # Edges are distinct, so their number and the sums of two hashes tell them apart without a shuffle.
    seen = [F.count("*"), *[F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64("hi", "lo"), F.xxhash64("lo", "hi", F.lit(1)))]]
    told = edges.agg(*seen).first()
    while True:
        edges, alone = _dealt(edges, told[0]), told[0] <= EDGES_AT_ONCE
        # Large star: neighbours above a node go to the smallest node next to it.
        both = edges.select(F.inline(F.array(_edge("hi", "lo", "n", "m"), _edge("lo", "hi", "n", "m"))))
        large = (_with_least(both, "n", "m", alone).filter(F.col("m") > F.col("n"))
                 .select(F.col("m").alias("hi"), F.least("n", "least").alias("lo")).distinct())
        # Small star: a node and its smaller neighbours go to the smallest of these.
        small = (_with_least(large, "hi", "lo", alone)
                 .select(F.inline(F.array(_edge("lo", "least", "hi", "lo"), _edge("hi", "least", "hi", "lo"))))
                 .filter(F.col("hi") != F.col("lo")).distinct())
        small = stored(small)
        edges, before, told = small, told, small.agg(*seen).first()
        if told == before:
            break
    nodes = _dealt(edges, told[0]).select(F.inline(F.array(_edge("hi", "lo", "node", "root"), _edge("lo", "lo", "node", "root"))))
    return nodes.groupBy("node").agg(F.min("root").alias("root"))


def _dealt(edges: DataFrame, count: int) -> DataFrame:
    return edges.coalesce(max(1, -(-count // EDGES_AT_ONCE)))


def _with_least(pairs: DataFrame, by: str, of: str, alone: bool) -> DataFrame:
    """`pairs` with `least`, the smallest `of` for each `by`: in place if they lie in one task, else combined and joined."""
    if alone:
        return pairs.withColumn("least", F.min(of).over(Window.partitionBy(by)))
    return pairs.join(pairs.groupBy(by).agg(F.min(of).alias("least")), by)


def _edge(a: str, b: str, *names: str) -> Column:
    return F.struct(*[F.col(c).alias(n) for c, n in zip((a, b), names)])


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: (id, fp, component_id), the smallest id reachable by links.

    Texts link when their fingerprints differ in at most `radius` bits. NULL, empty and
    blank texts have fingerprint 0 and link like any other. A NULL id is never the smallest;
    the component of NULL ids alone is NULL. Repeated rows stay. Other columns are not read.
    """
    fps = stored(simhash(docs, width, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = components(links(classes.select("fp"), radius))
    rooted = (classes.join(roots, classes["fp"] == roots["node"], "left")
              .select("fp", "_least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    labels = rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return (fps.join(labels, F.col("fp") == F.col("_fp"))
            .select(id_col, "fp", "component_id"))


def hex_digits(fp: str = "fp") -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- groups of similar texts -------------------------------------------------------------

#: Bits of a fingerprint by which similar texts are looked up; radius 2 as above.
TABLE_BITS = 32


def signatures(docs: DataFrame, width: int, tables: int, text_col: str) -> DataFrame:
    """(h, s, n): a hash of every distinct text, its signature, two tables in each number, and its shingles."""
    numbers = [*[f"s{i}" for i in range(tables // 2)], "n"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([signature(t.as_py(), width, tables // 2)
                              for t in batch.column(1).cast(pa.binary())], dtype="<u8").view("<i8")
            found = found.reshape(-1, len(numbers))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)],
                names=["h", *numbers])

    rows = docs.select(text_hash(text_col).alias("h"), F.col(f"`{text_col}`").cast("string").alias("t"))
    each = rows.mapInArrow(hashed, ", ".join(["h long", *(f"{n} long" for n in numbers)]))
    return (each.groupBy("h").agg(*[F.first(n).alias(n) for n in numbers])
            .select("h", F.array(*numbers[:-1]).alias("s"), "n"))


def may_be_alike(similarity: float, tables: int, a: str, b: str) -> Column:
    """Whether texts (s_a, n_a) and (s_b, n_b) can reach the similarity.

    Set sizes further apart than it allows rule it out; so do signatures that differ in more than the mean
    share of bits at the similarity and three deviations.
    """
    differ = F.aggregate(F.zip_with(f"s_{a}", f"s_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda total, x: total + x)
    angle, bits = acos(2 * similarity / (1 + similarity)) / pi, TABLE_BITS * tables
    sizes = F.least(f"n_{a}", f"n_{b}") >= similarity * F.greatest(f"n_{a}", f"n_{b}")
    return sizes & (differ <= angle * bits + 3 * sqrt(angle * (1 - angle) * bits))


#: So many hashes are sent to every task, which drops the other texts before they are dealt by hash.
SENT_HASHES = 100_000


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """(h, set): the distinct shingles, as 32-bit hashes, of the texts whose hash is wanted."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), width).astype("<u4").view("<i4"))
                     for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["h", "set"])

    texts = docs.select(text_hash(text_col).alias("h"), F.col(f"`{text_col}`").cast("string").alias("t"))
    wanted = stored(wanted.toDF("_w"))
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_HASHES else wanted
    own = texts.join(wanted, F.col("h") == F.col("_w"), "left_semi").dropDuplicates(["h"])
    return own.mapInArrow(sets, "h long, set array<int>")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, tables: int = 12,
                  text_col: str = "text") -> DataFrame:
    """(h, root): the group of every distinct text (by hash); copies share a hash.

    A single fingerprint within 2 bits finds near-equal texts only. Here every text has
    `tables` independent fingerprints of 32 bits, and texts meet if any two are within 2 bits.
    Pairs that met are screened by the whole signature (32 x `tables` bits) and then verified:
    the Jaccard similarity of their sets of shingles must reach `similarity`. First each text is
    verified with the smallest of its buckets only, which settles families of near copies; then
    all that met and are not in one group yet are verified pair by pair.
    """
    sigs = stored(signatures(docs, width, tables, text_col))
    shift = [(F.shiftrightunsigned(F.get("s", t // 2), TABLE_BITS * (t % 2)).bitwiseAND((1 << TABLE_BITS) - 1)
              + (t << TABLE_BITS)) for t in range(tables)]
    keys = sigs.select("h", F.explode(F.array(*shift)).alias("key"))
    # Texts with one fingerprint are folded into the smallest, so a bucket holds few.
    heads = keys.groupBy("key").agg(F.min("h").alias("n"), F.count("*").alias("m"))
    same = (keys.join(heads.filter("m > 1").select("key", "n"), "key")
            .filter(F.col("h") != F.col("n")).select(F.col("n").alias("a"), F.col("h").alias("b")))
    # A variant and its number travel in one long, which takes less room than the variant and its key.
    variants = heads.select(F.posexplode(variants_of("key")).alias("nth", "v")).select(
        F.shiftleft("v", 6).bitwiseOR(F.col("nth").cast("long")).alias("_v"))
    variants = variants.repartition(F.shiftright("_v", 6)).select(
        F.shiftright("_v", 6).alias("v"), F.col("_v").bitwiseAND(F.lit(63)).cast("int").alias("nth"))
    # Buckets by a window: its sort spills, and no list is built. Those of two keys and more stay.
    bucket = Window.partitionBy("v")
    met_more = variants.select("v", "nth", F.count("*").over(bucket).alias("m")).filter("m > 1")
    buckets = stored(met_more.select("v", key_of("v", "nth").alias("key")))
    least = F.min("n").over(bucket)
    met = (buckets.join(heads.select("key", "n"), "key")
           .select(least.alias("a"), F.col("n").alias("b")).filter("a < b"))
    heads = stored(screened(same.union(met).distinct(), sigs, similarity, tables))
    edges = stored(alike(docs, heads, width, similarity, text_col))
    # The edges to a third text may have failed where two of a bucket are alike.
    rest = apart(docs, sigs, keys, buckets, heads, components(edges), width, similarity, tables, text_col)
    rest = alike(docs, stored(rest), width, similarity, text_col)
    groups = components(edges.union(rest))
    return (sigs.join(groups, sigs["h"] == groups["node"], "left")
            .select("h", F.coalesce("root", "h").alias("root")))


def variants_of(key: str) -> Column:
    """The key and all keys that differ from it in one of the `TABLE_BITS` bits."""
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(TABLE_BITS))]])
    return F.transform(masks, lambda m: F.col(key).bitwiseXOR(m))


def key_of(variant: str, nth: str) -> Column:
    """The key whose nth variant this is."""
    bit = F.expr(f"if({nth} = 0, 0L, shiftleft(1L, {nth} - 1))")
    return F.col(variant).bitwiseXOR(bit)


def apart(docs: DataFrame, sigs: DataFrame, keys: DataFrame, buckets: DataFrame, near: DataFrame, roots: DataFrame,
          width: int, similarity: float, tables: int, text_col: str) -> DataFrame:
    """(a, b), a < b: texts that meet in a bucket, are in different groups by `roots` and may be alike.

    Texts linked by `near` (pairs that met and passed the screen) are a family. Pairs inside a family
    are told by what sets its texts apart, without making all that met; those of two families are made.
    """
    rooted = stored(grouped(grouped(sigs, roots, "root"), components(near), "family"))
    inside = within_families(docs, rooted, keys, buckets, width, similarity, tables, text_col)
    return inside.union(between_families(rooted, keys, buckets, similarity, tables)).distinct()


def grouped(texts: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """`texts` with the group of each, itself where it has none."""
    return (texts.join(groups.toDF("_node", "_root"), F.col("h") == F.col("_node"), "left")
            .select(*texts.columns, F.coalesce("_root", "h").alias(name)))


def meet(a: str, b: str) -> Column:
    """Whether any two fingerprints of one table are within 2 bits."""
    low = F.lit((1 << TABLE_BITS) - 1)
    return F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), lambda x: (
        (F.bit_count(x.bitwiseAND(low)) <= 2) | (F.bit_count(F.shiftrightunsigned(x, TABLE_BITS)) <= 2)))


#: Shared elements are asked for by doubles; so much less is asked, which lets more pairs through, never fewer.
_SLACK = 1e-6


def shared_least(q: Column, other: Column) -> Column:
    """How many elements off the core two alike texts share at least, if any."""
    return F.greatest(F.lit(1), F.ceil((q + other) / 2 - _SLACK))


def within_families(docs: DataFrame, rooted: DataFrame, keys: DataFrame, buckets: DataFrame, width: int,
                    similarity: float, tables: int, text_col: str) -> DataFrame:
    """(a, b), a < b: texts that meet, of one family and different groups, all that are alike among them, few others.

    A family's core are the shingles that more than half of its texts hold. Let `off` be a text's shingles
    outside the core and those of the core that it lacks. Alike texts x and y differ in at most
    c (|x| + |y|) shingles, c = (1 - s) / (1 + s); so with q = |off| - c |x| they share at least
    (q_x + q_y) / 2 elements of `off`. Where that is positive, the two share one among the first
    |off| - least + 1 of each in one order, rare ones first; pairs that do not are never made. `least` depends on
    the other text, so elements are sent to bands of q. Where it is not, x and y are alike for certain, and both
    are alike with the text of the least q in the bucket where they meet: those pairs stand for all of them.
    """
    split = (rooted.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"))
             .filter("lo < hi").select("family", "members"))
    texts = stored(rooted.join(split, "family"))
    sets = shingle_sets(docs, texts.select("h"), width, text_col)
    texts = stored(texts.join(sets, "h"))
    counts = stored(texts.select("family", "members", F.explode("set").alias("e"))
                    .groupBy("family", "members", "e").agg(F.count("*").alias("c")))
    cores = counts.filter("2 * c > members").groupBy("family").agg(F.collect_list("e").alias("core"))
    share = (1 - similarity) / (1 + similarity)
    off = (texts.join(cores, "family", "left").withColumn("core", F.coalesce("core", F.array().cast("array<int>")))
           .select("h", "root", "family", "s", "n", F.concat(F.array_except("set", "core"), F.array_except("core", "set")).alias("off"),
                   F.size("set").alias("size")))
    off = stored(off.select("h", "root", "family", "s", "n", "off", (F.size("off") - share * F.col("size")).alias("q")))

    # Alike for certain: with the text of the least q in the key or the bucket.
    known = keys.join(off.select("h", "root", "family", "q"), "h")
    lows = known.groupBy("key", "family").agg(F.min(F.struct("q", "h", "root")).alias("low"))
    met = buckets.join(lows, "key").select(
        "key", "family", F.min("low").over(Window.partitionBy("v", "family")).alias("low"))
    lows = met.union(lows).filter(F.col("low.q") <= _SLACK).distinct().select(
        "key", "family", F.col("low.q").alias("_q"), F.col("low.h").alias("_h"), F.col("low.root").alias("_root"))
    certain = known.join(lows, ["key", "family"]).filter((F.col("q") + F.col("_q") <= _SLACK) & (F.col("root") != F.col("_root")))
    certain = certain.select(F.least("h", "_h").alias("a"), F.greatest("h", "_h").alias("b"))

    # All others: by a shared element among the first of both.
    least = off.groupBy("family").agg(F.min("q").alias("q0"))
    off = stored(off.join(least, "family").withColumn("band", F.floor(F.log2(F.col("q") - F.col("q0") + 1)).cast("int")))
    # The bands join the texts, for their elements are many and a family may hold most of them.
    bands = off.groupBy("family").agg(F.collect_set("band").alias("bands"))
    each = (off.join(bands, "family")
            .select("h", "root", "family", "s", "n", "q", "q0", "band", "bands", F.size("off").alias("len"), F.explode("off").alias("e"))
            .join(counts.select("family", "e", F.least("c", F.col("members") - F.col("c")).alias("held")), ["family", "e"])
            .withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("held", "e"))))
    last = lambda n, q, other: F.col(n) - shared_least(F.col(q), other) + 1
    sent = (each.withColumn("to", F.explode(F.filter("bands", lambda b: F.col("nth") <= last(
                "len", "q", F.col("q0") + F.pow(F.lit(2.0), b) - 1))))
            .select("h", "root", "family", "s", "n", "q", "len", "nth", "e", "band", "to"))
    meeting = Window.partitionBy("family", "e", F.least("band", "to"), F.greatest("band", "to"))
    sent = stored(sent.withColumns({"_lo": F.min("root").over(meeting), "_hi": F.max("root").over(meeting)})
                  .filter("_lo < _hi").drop("_lo", "_hi"))
    x = sent.select("family", "e", F.col("band").alias("b1"), F.col("to").alias("b2"), *each_as(sent, "x"))
    y = sent.select(F.col("family").alias("_f"), F.col("e").alias("_e"), F.col("to").alias("_b1"), F.col("band").alias("_b2"),
                    *each_as(sent, "y"))
    on = [F.col(c) == F.col(d) for c, d in (("family", "_f"), ("e", "_e"), ("b1", "_b1"), ("b2", "_b2"))]
    first = ((F.col("nth_x") <= last("len_x", "q_x", F.col("q_y"))) & (F.col("nth_y") <= last("len_y", "q_y", F.col("q_x"))))
    others = x.join(y, [*on, F.col("h_x") < F.col("h_y"), F.col("root_x") != F.col("root_y"), first, meet("s_x", "s_y"),
                        may_be_alike(similarity, tables, "x", "y")])
    return certain.union(others.select(F.col("h_x").alias("a"), F.col("h_y").alias("b"))).distinct()


def each_as(df: DataFrame, side: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{side}") for c in ("h", "root", "s", "n", "q", "len", "nth")]


def between_families(rooted: DataFrame, keys: DataFrame, buckets: DataFrame, similarity: float, tables: int) -> DataFrame:
    """(a, b), a < b: all texts that meet in a bucket, are in different families and may be alike.

    Pairs of keys and their families come first, each once (a key has at most 528 others within 2
    bits); their texts are screened where they meet.
    """
    texts = stored(keys.join(rooted.select("h", "family"), "h").select("key", "family", "h"))
    held = texts.select("key", "family").distinct()
    bucket = Window.partitionBy("v")
    variants = stored(buckets.join(held, "key")
                      .select("v", "key", "family", F.min("family").over(bucket).alias("lo"), F.max("family").over(bucket).alias("hi"))
                      .filter("lo < hi").drop("lo", "hi"))
    several = texts.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).filter("lo < hi").select("key")
    alone = held.join(several, "key", "left_semi").select(F.col("key").alias("v"), "key", "family")
    x, y = (variants.select("v", F.col("key").alias("key_x"), F.col("family").alias("family_x")),
            variants.select("v", F.col("key").alias("key_y"), F.col("family").alias("family_y")))
    # Keys that differ meet in two variants; the pair is taken in the smaller.
    other = F.col("key_x").bitwiseXOR(F.col("key_y")).bitwiseXOR(F.col("v"))
    met = (x.join(y, "v").filter((F.col("key_x") < F.col("key_y")) & (F.col("v") < other) & (F.col("family_x") != F.col("family_y")))
           .drop("v"))
    x, y = (alone.select("v", F.col("key").alias(f"key_{i}"), F.col("family").alias(f"family_{i}")) for i in "xy")
    met = stored(met.union(x.join(y, "v").filter("family_x < family_y").select(*met.columns)))
    wanted = met.select("key_x", "family_x").union(met.select("key_y", "family_y")).distinct().toDF("key", "family")
    texts = stored(texts.join(wanted, ["key", "family"], "left_semi").join(rooted.select("h", "s", "n"), "h"))
    x, y = (texts.select(*[F.col(c).alias(f"{c}_{side}") for c in texts.columns]) for side in "xy")
    near = [F.col("_key") == F.col("key_y"), F.col("_family") == F.col("family_y"), may_be_alike(similarity, tables, "x", "y")]
    met = met.withColumnsRenamed({"key_y": "_key", "family_y": "_family"})
    pairs = met.join(x, ["key_x", "family_x"]).join(y, near)
    return pairs.select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).distinct()


def screened(pairs: DataFrame, sigs: DataFrame, similarity: float, tables: int) -> DataFrame:
    """The pairs (a, b) that may be alike by their signatures and sizes."""
    a, b = (sigs.select(*[F.col(c).alias(f"{c}_{side}") for c in ("h", "s", "n")]) for side in "ab")
    return (pairs.join(a, F.col("a") == F.col("h_a"))
            .join(b, (F.col("b") == F.col("h_b")) & may_be_alike(similarity, tables, "a", "b")).select("a", "b"))


def alike(docs: DataFrame, near: DataFrame, width: int, similarity: float, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets of shingles reach the Jaccard similarity."""
    sets = shingle_sets(docs, near.select("a").union(near.select("b")).distinct(), width, text_col)
    a, b = F.col("a_set"), F.col("b_set")
    both = F.size(F.array_intersect(a, b))
    return (near.join(sets.select(F.col("h").alias("a"), F.col("set").alias("a_set")), "a")
            .join(sets.select(F.col("h").alias("b"), F.col("set").alias("b_set")), "b")
            .filter(both >= similarity * (F.size(a) + F.size(b) - both)).select("a", "b"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, tables: int = 12,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of similar texts: the one with the smallest id.

    Exact copies and repeated rows are one group; so are all texts without words (NULL, empty,
    blank). NULL ids come last. All columns stay.
    """
    groups = similar_texts(docs, width, similarity, tables, text_col)
    ids = docs.groupBy(text_hash(text_col).alias("_h")).agg(F.min(f"`{id_col}`").alias("_id"))
    first = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_h"))
    kept = (groups.join(ids, groups["h"] == ids["_h"]).groupBy("root")
            .agg(F.min_by("_h", first).alias("_llm_keep")).select("_llm_keep"))
    nth = F.row_number().over(Window.partitionBy("_llm_h").orderBy(F.col(f"`{id_col}`").asc_nulls_last()))
    firsts = (docs.withColumn("_llm_h", text_hash(text_col)).withColumn("_llm_n", nth)
              .filter(F.col("_llm_n") == 1))
    return (firsts.join(kept, firsts["_llm_h"] == kept["_llm_keep"], "left_semi")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
