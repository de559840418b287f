"""Document fingerprints: a threshold-scaled sketch of word shingles, in SQL functions only.

Every shingle is hashed (the leading 60 bits of its MD5) and kept when the hash is below a
fixed fraction of the range. Since the threshold does not depend on the document, sketches
of unequal documents can be intersected, merged and compared for containment directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from acreline.llm.common import WORD, shuffle_partitions

HASH_DIGITS = 15


def threshold(scale: int) -> str:
    """The smallest hash that is not kept, as hexadecimal digits."""
    return format(16 ** HASH_DIGITS // scale, f"0{HASH_DIGITS}x")


def with_sketch(df: DataFrame, text: str, out: str, width: int = 5, scale: int = 4) -> DataFrame:
    """Add `out`: sorted distinct kept hashes of the text's shingles, as array<bigint>.

    A text of fewer words than `width` is one shingle; one without words (NULL, empty, blank)
    has an empty sketch. If no hash is below the threshold, the smallest is kept, so only
    texts without words have empty sketches; this too survives merging.
    """
    words = df.withColumn("_words", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))
    n = F.size("_words")

    def hashed(shingle: Column) -> Column:
        return F.substring(F.md5(shingle.cast("binary")), 1, HASH_DIGITS)

    hashes = (F.when(n == 0, F.array().cast("array<string>"))
              .when(n <= width, F.array(hashed(F.array_join("_words", " "))))
              .otherwise(F.transform(
                  F.slice("_words", F.lit(1), F.greatest(n - (width - 1), F.lit(0))),
                  lambda w, i: hashed(F.concat_ws(" ", w, *[F.get("_words", i + k) for k in range(1, width)])))))
    all_ = words.withColumn("_hashes", hashes).drop("_words")
    below = all_.withColumn("_kept", F.filter("_hashes", lambda h: h < threshold(scale)))
    kept = F.when((F.size("_kept") == 0) & (F.size("_hashes") > 0),
                  F.array(F.array_min("_hashes"))).otherwise(F.col("_kept"))
    number = F.transform(kept, lambda h: F.conv(h, 16, 10).cast("bigint"))
    return below.withColumn(out, F.array_sort(F.array_distinct(number))).drop("_hashes", "_kept")


def as_text(sketch: str | Column) -> Column:
    """A sketch as fixed-width hexadecimal hashes in one string."""
    return F.lower(F.array_join(F.transform(
        sketch, lambda h: F.lpad(F.hex(h), HASH_DIGITS, "0")), ""))


def merge(a: str | Column, b: str | Column) -> Column:
    """The sketch of both documents together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two texts without words are alike."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated share of the first document's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows with the range of `key` that they fall in, and copies of each range's first rows.

    Ranges are cut at approximate percentiles; their number follows the number of shuffle
    partitions. The first rows of a range stand in the range before it as well (those of the
    first in the last), so `next_of` finds every row's successor within one range: rows move
    once and no task orders the whole table.
    """
    spark = df.sparkSession
    side = max(2, int((4 * shuffle_partitions(spark)) ** 0.5))
    ranges = side * side
    shares = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    if isinstance(df.schema[key].dataType, (NumericType, DateType, TimestampType)):
        cuts = df.agg(F.percentile_approx(key, shares, 20 * ranges)).first()[0]
    else:
        # Keys without a distance: the keys alone are dealt by ranges, and each range's first is a cut.
        parted = df.select(F.col(key).alias("_k")).dropna().repartitionByRange(ranges, "_k")
        lows = parted.groupBy(F.spark_partition_id().alias("_p")).agg(F.min("_k").alias("_k"))
        cuts = [r["_k"] for r in lows.orderBy("_k").collect()][1:]  # one row a range
    bucket = F.lit(0)
    if cuts:
        # Two short searches: the block of cuts, then the cut in it.
        kind = f"array<{df.schema[key].dataType.simpleString()}>"
        blocks = [cuts[i:i + side] for i in range(0, len(cuts), side)]
        heads = F.array(*[F.lit(b[-1]) for b in blocks]).cast(kind)
        table = F.array(*[F.array(*[F.lit(c) for c in b]).cast(kind) for b in blocks])
        block = F.size(F.filter(heads, lambda c: c <= F.col(key)))
        inside = F.size(F.filter(F.coalesce(F.get(table, block), F.array().cast(kind)),
                                 lambda c: c <= F.col(key)))
        bucket = block * side + inside
    rows = df.withColumns({"_range": F.coalesce(bucket, F.lit(0)), "_copy": F.lit(False)})
    order = Window.orderBy("_range")  # over one row for each range
    firsts = (rows.groupBy("_range").agg(F.min(key).alias("_least"),
                                         F.count(F.when(F.col(key).isNull(), 1)).alias("_nulls"))
              .select(F.when(F.col("_nulls") == 0, F.col("_least")).alias("_first"),
                      F.coalesce(F.lag("_range").over(order),
                                 F.max("_range").over(order.rowsBetween(
                                     Window.unboundedPreceding, Window.unboundedFollowing)))
                      .alias("_before")))
    # One row for each range.
    firsts = F.broadcast(firsts)
    copies = (rows.join(firsts, rows[key].eqNullSafe(firsts["_first"]))
              .select(*[rows[c] for c in df.columns], F.col("_before").alias("_range"),
                      F.lit(True).alias("_copy")))
    return rows.unionByName(copies)


def next_of(rows: DataFrame, key: str, columns: dict[str, str], ties: list[str]) -> DataFrame:
    """Add `{out: column}` of the next row in ascending `key` to `dealt` rows, and drop the copies.

    The last row's next is the first. NULL keys come first; equal keys are ordered by `ties`.
    """
    w = Window.partitionBy("_range").orderBy("_copy", F.col(key).asc_nulls_first(),
                                             *[F.col(t).asc_nulls_first() for t in ties])
    return (rows.withColumns({out: F.lead(c).over(w) for out, c in columns.items()})
            .filter(~F.col("_copy")).drop("_range", "_copy"))


def fingerprint_edits(docs: DataFrame, width: int = 5, scale: int = 4, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose tail is the next text's head.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The
    last floor(n_chars / 4) code points are replaced by the first as many of the next document
    in ascending id (all of it if it is shorter; the first document follows the last). NULL
    text counts as empty. One document alone is its own next. Repeated ids are ordered by
    text. Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"),
                                                              F.lit("")).alias("_text"))
    own = with_sketch(dealt(base, "_id"), "_text", "_sketch", width, scale)
    paired = next_of(own, "_id", {"_next_text": "_text", "_next_sketch": "_sketch"}, ["_text"])
    n, cut = F.char_length("_text"), F.floor(F.char_length("_text") / 4).cast("int")
    edited = paired.withColumn("_edited", F.concat(
        F.substring("_text", F.lit(1), n - cut), F.substring("_next_text", F.lit(1), cut)))
    done = with_sketch(edited, "_edited", "_edited_sketch", width, scale)
    return done.select(
        F.col("_id").alias(id_col), n.cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text("_sketch").alias("fingerprint"), as_text("_edited_sketch").alias("edited_fingerprint"),
        likeness("_sketch", "_edited_sketch").alias("near_edited"),
        likeness("_sketch", "_next_sketch").alias("near_next"))



#: DuckDB SQL of `fingerprint_edits` with the default width and scale.
FINGERPRINT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt
      FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, t)),
e AS (SELECT doc_id, t, nt, length(t) AS n_chars,
             left(t, (length(t) - length(t) // 4)::BIGINT) || left(nt, (length(t) // 4)::BIGINT) AS et FROM n),
texts AS (SELECT t AS s FROM e UNION SELECT et FROM e),
words AS (SELECT s, regexp_extract_all(s, '{WORD}') AS w FROM texts),
hashes AS (SELECT s, list_distinct(list_transform(
      CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END,
      lambda x: substr(md5(x), 1, {HASH_DIGITS}))) AS h FROM words),
sketch AS (SELECT s, list_sort(CASE
      WHEN len(list_filter(h, lambda x: x < '{threshold(4)}')) = 0 AND len(h) > 0 THEN [list_min(h)]
      ELSE list_filter(h, lambda x: x < '{threshold(4)}') END) AS k FROM hashes),
j AS (SELECT e.doc_id, e.n_chars, e.et, a.k AS a, b.k AS b, c.k AS c,
             len(list_intersect(a.k, b.k)) AS ab, len(list_intersect(a.k, c.k)) AS ac
      FROM e JOIN sketch a ON a.s = e.t JOIN sketch b ON b.s = e.et JOIN sketch c ON c.s = e.nt)
SELECT doc_id, n_chars, sha256(et) AS edited_sha256,
       array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE ab / (len(a) + len(b) - ab) END::DOUBLE AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE ac / (len(a) + len(c) - ac) END::DOUBLE AS near_next
FROM j"""
