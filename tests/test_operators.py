import statistics

import pytest
from pyspark.sql import functions as F

from acreline.operators import aggregates as ag
from acreline.operators import checks as ck
from acreline.operators import joins as j
from acreline.operators import sets
from acreline.operators import windows as wn
from acreline.operators.running import running


@pytest.fixture(scope="module")
def skewed(spark):
    """A log in which one key holds a third of the rows."""
    k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97)
    v = F.when(F.col("id") % 5 > 0, (F.col("id") * 7919) % 1009)
    return spark.range(6000).select(k.alias("k"), F.col("id").alias("n"), v.alias("v")).cache()


def job_count(spark, action):
    """How many jobs an action starts."""
    group = f"count-{id(action)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("fn", ["sum", "max", "min", "last", "first"])
def test_chunked_scan_equals_window(skewed, fn):
    spec = {"out": (fn, "v")}
    plain = running(skewed, ["k"], "n", spec)
    chunked = running(skewed, ["k"], "n", spec, chunk=F.floor(F.col("n") / 250))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, chunked.collect()), key=str)


def test_chunked_product_equals_window(spark):
    df = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("n"), (1 + F.col("id") % 3 / 100).alias("v"))
    plain = running(df, ["k"], "n", {"out": ("product", "v")}).collect()
    chunked = running(df, ["k"], "n", {"out": ("product", "v")}, chunk=F.floor(F.col("n") / 20)).collect()
    a, b = ({r["n"]: r["out"] for r in x} for x in (plain, chunked))
    assert all(abs(a[n] - b[n]) < 1e-12 * a[n] for n in a)


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_median_is_exact_on_skewed_groups(skewed, accuracy):
    got = {r["k"]: r["median"] for r in ag.median_by(skewed, "k", "v", accuracy=accuracy).collect()}
    groups = {}
    for r in skewed.filter("v IS NOT NULL").collect():
        groups.setdefault(r["k"], []).append(r["v"])
    assert got == {k: statistics.median(x) for k, x in groups.items()}
    whole = ag.median_by(skewed, [], "v", accuracy=accuracy).collect()[0]["median"]
    assert whole == statistics.median([x for g in groups.values() for x in g])


def test_a_missed_bracket_is_an_error_and_no_rank_is_in_one_task(spark, skewed):
    # Without slack and with a coarse sketch the bracket is one value, beside the median.
    uneven = spark.range(4001).select((F.col("id") * F.col("id")).alias("v"))
    with pytest.raises(Exception, match="outside its bracket"):
        for accuracy in (3, 5, 7, 9):
            ag.median_by(uneven, [], "v", accuracy=accuracy, slack=0).collect()
    plan = ag.median_by(skewed, [], "v")._jdf.queryExecution().executedPlan().toString()
    ranks = [line for line in plan.splitlines() if "Window " in line and "_here" in line and "_v" in line]
    assert ranks and all("[_range" in line.split("windowspecdefinition(")[1][:30] or "_range" in line for line in ranks)


def columns_of(spark, rows):
    """Fifty columns: ties, gaps, one value, none, skew."""
    x = F.xxhash64("id", F.lit(1)) % 1000
    cols = [F.when(x % (k + 1) > 0, (x * (k + 3)) % (7 * k + 11)).cast("double").alias(f"c{k}") for k in range(46)]
    return spark.range(rows).select(*cols, F.lit(None).cast("int").alias("none"), F.lit(5).alias("one"),
                                    F.when(F.col("id") == 3, 1.5).alias("single"), F.exp(x / 10.0).alias("steep"))


@pytest.mark.parametrize("options", [{}, {"accuracy": 50}, {"accuracy": 100, "most": 20}, {"accuracy": 50, "slack": 0, "most": 20}])
def test_medians_of_fifty_columns(spark, options):
    df = columns_of(spark, 701).coalesce(1).cache()
    got = ag.medians(df, df.columns, **options)
    for c in df.columns:
        known = [r[0] for r in df.select(c).dropna().collect()]
        assert got[c] == (statistics.median(known) if known else None), c
    df.unpersist()


def test_medians_take_two_aggregates_and_no_unpivot(spark):
    df = columns_of(spark, 2000).repartition(3)
    plans = []
    whole = type(df).agg

    def seen(self, *aggs):
        out = whole(self, *aggs)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    type(df).agg = seen
    try:
        assert len(ag.medians(df, df.columns)) == 50
    finally:
        type(df).agg = whole
    assert len(plans) == 2 and not any(x in p for p in plans for x in ("Expand", "Generate", "Join"))


def test_years_since_with_and_without_chunks(skewed):
    flagged = skewed.withColumn("flag", (F.col("v") > 900).cast("int"))
    a = wn.years_since(flagged, "k", "n", "flag").select("n", "years_since").collect()
    b = wn.years_since(flagged, "k", "n", "flag", chunk=F.floor(F.col("n") / 100)).select("n", "years_since").collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_top_n_is_limited_before_the_shuffle(skewed):
    plan = wn.top_n(skewed, "k", ["v", "n"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_shares_sum_to_one(skewed):
    sums = ag.share(skewed, "k", "v").groupBy("k").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    small = ag.share(skewed, "k", "v", small_groups=True).groupBy("k").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in small)


def test_with_group_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "k string, v int")
    got = ag.with_group(df, "k", {"s": F.sum("v")}).collect()
    assert sorted((r["k"] or "", r["s"]) for r in got) == [("", 3), ("", 3), ("a", 5)]
    assert [r["s"] for r in ag.with_group(df, [], {"s": F.sum("v")}).collect()] == [8, 8, 8]


def test_mode_takes_first_seen_on_ties(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b")], "k int, n int, v string")
    assert ag.mode_of(df, "k", "v", ["n"]).collect()[0]["v"] == "b"


def test_weighted_mean_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, None, None), (2, 2.0, None)], "k int, x double, w double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(ag.weighted_mean("x", "w").alias("m")).collect()}
    assert got == {1: 2.0, 2: None}


def test_dominant_needs_a_plurality(spark):
    df = spark.createDataFrame([(1, "a", 6), (1, "b", 4), (2, "a", 4), (2, "b", 3), (2, "c", 3)], "k int, c string, w int")
    assert [(r["k"], r["c"]) for r in ag.dominant(df, "k", "c", "w").collect()] == [(1, "a")]


def test_vote_ties_go_to_best_source(spark):
    df = spark.createDataFrame([(1, "a", "low"), (1, "b", "high")], "k int, c string, src string")
    assert ag.vote(df, "k", "c", wn.rank_in("src", ["high", "low"])).collect()[0]["c"] == "b"


def test_update_overwrites_with_null_and_fill_does_not(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    upd = spark.createDataFrame([(1, None), (2, "new")], "k int, v string")
    get = lambda out: {r["k"]: r["v"] for r in out.collect()}
    assert get(j.update_join(df, upd, "k", ["v"])) == {1: None, 2: "new", 3: "c"}
    assert get(j.fill_join(df, upd, "k", ["v"])) == {1: "a", 2: "new", 3: "c"}
    assert get(j.overlay_join(df, upd, "k", ["v"])) == {1: "a", 2: "new", 3: "c"}


def test_left_join_unique_rejects_repeated_keys(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    jobs = job_count(spark, lambda: j.left_join_unique(left, right, "k"))
    assert jobs == 0  # the check is part of the plan
    with pytest.raises(Exception, match="repeated keys"):
        j.left_join_unique(left, right, "k").collect()
    many = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "k int, v string")
    assert [r["v"] for r in j.left_join_unique(left, many, "k").collect()] == ["c"]


def test_ambiguous_keys_are_not_matched(spark):
    right = spark.createDataFrame([("p1", "a", "x"), ("p2", "a", "y"), ("p3", "b", "y")],
                                  "parcel_id string, k1 string, k2 string")
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "q"), (3, "c", "y")], "id int, k1 string, k2 string")
    got = {r["id"]: (r["parcel_id"], r["match_pass"]) for r in j.two_pass_match(left, right, ["k1", "k2"]).collect()}
    assert got == {1: ("p1", 2), 2: ("p3", 1), 3: (None, None)}


def test_changes_point_and_until_next(spark):
    panel = spark.createDataFrame([("a", y, "base", 1.0, True) for y in range(2008, 2013)],
                                  "parcel_id string, tax_yr int, zone string, size double, flag boolean")
    rows = [("a", 2010, "zone", "new", "2010-05-01"), ("a", 2010, "zone", "late", "2010-06-01"),
            ("a", 2011, "size", "7", "2011-01-01"), ("a", 2012, "flag", "N", "2012-01-01")]
    changes = spark.createDataFrame(rows, "parcel_id string, eff_yr int, attribute string, attribute_value string, update_date string")
    attrs = {"zone": "zone", "size": "size", "flag": "flag"}
    run = lambda carry: {r["tax_yr"]: (r["zone"], r["size"], r["flag"]) for r in j.apply_changes(
        panel, changes, attrs, carry=carry).collect()}
    assert run("until_next") == {2008: ("base", 1.0, True), 2009: ("base", 1.0, True), 2010: ("late", 1.0, True),
                                 2011: ("late", 7.0, True), 2012: ("late", 7.0, False)}
    assert run("point") == {2008: ("base", 1.0, True), 2009: ("base", 1.0, True), 2010: ("late", 1.0, True),
                            2011: ("base", 7.0, True), 2012: ("base", 1.0, False)}
    with pytest.raises(ValueError):
        j.apply_changes(panel, changes, attrs, carry="other")


def test_interval_never_counts_down(spark):
    df = spark.createDataFrame([(1, 2005, 2003), (2, 1990, 2001), (3, 2009, 2020), (4, 1980, 1985)], "id int, a int, b int")
    got = [(r["id"], r["tax_yr"]) for r in j.expand_interval(df, "a", "b", 2000, 2010).collect()]
    assert sorted(got) == [(2, 2000), (2, 2001), (3, 2009), (3, 2010)]


def test_cum_prod_stops_at_null(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 3.0)], "k int, n int, f double")
    assert [r["cum"] for r in wn.cum_prod(df, "k", "n", "f").orderBy("n").collect()] == [2.0, None, None]


def test_overlap_and_stack(spark):
    a, b = spark.range(10).select("id"), spark.range(5, 20).select("id")
    assert tuple(sets.overlap(a, b, "id").collect()[0]) == (10, 15, 5, 50.0)
    assert sets.stack([a, b.withColumn("x", F.lit(1))]).filter("x IS NULL").count() == 10


def test_strict_checks_raise(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    assert ck.check_unique(df, ["k"]).collect()[0]["n"] == 2
    assert job_count(spark, lambda: ck.check_unique(df, ["k"], strict=True)) == 0
    with pytest.raises(Exception, match="duplicate keys"):
        ck.check_unique(df, ["k"], strict=True).collect()
    assert ck.check_unique(df.distinct(), ["k"], strict=True).isEmpty()


def test_checks_ride_along_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    checks = lambda d: {"keys repeat": ck.check_unique(d, ["k"]), "v is unknown": d.filter("v IS NULL")}
    good = df.dropna()
    assert job_count(spark, lambda: ck.guarded(good, checks(good))) == 0
    ck.guarded(good, checks(good)).write.parquet(str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    with pytest.raises(Exception, match="v is unknown"):
        ck.guarded(df, checks(df)).write.parquet(str(tmp_path / "bad"))
    twice = good.union(good)
    with pytest.raises(Exception, match="keys repeat"):
        ck.guarded(twice, checks(twice)).collect()
