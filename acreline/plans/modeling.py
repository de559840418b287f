"""Model frames, training, scoring and evaluation with Spark ML.

Only small results reach the driver: year lists, one row of column statistics,
medians and scores. Gradient-boosted trees have no monotone constraints and take
no NULLs, so features are imputed first and predicted changes are clamped later.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial
from threading import Condition

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from acreline.functions import codes
from acreline.functions.cleaning import log_pos
from acreline.functions.labels import first_match
from acreline.operators.aggregates import error_metrics, medians
from acreline.operators.filters import drop_like, drop_null
from acreline.operators.joins import attach_drivers, expand_snapshot
from acreline.operators.sets import stack
from acreline.operators.windows import fill_both, growth, last_row, top_n
from acreline.sources.extracts import shared_dir
from acreline.sources.published import current, publish

KEY, YEAR = "parcel_id", "tax_yr"


# -- folds and weights -------------------------------------------------------

def distinct_years(df: DataFrame, year: str = YEAR) -> list[int]:
    return sorted(r[0] for r in df.select(year).distinct().collect() if r[0] is not None)


def rolling_year_folds(df: DataFrame, n: int = 5, min_train: int = 3,
                       year: str = YEAR) -> DataFrame:
    """Fold table (fold, cut_yr): train up to the cut, validate on all later years.

    Up to n evenly spaced cuts from the `min_train`-th to the last but one year;
    too few years give an empty table.
    """
    years = distinct_years(df, year)
    schema = "fold int, cut_yr int"
    if len(years) < min_train + 1:
        return df.sparkSession.createDataFrame([], schema)
    last = len(years) - 1
    steps = n if min_train < last else 1
    span = (last - min_train) / (steps - 1) if steps > 1 else 0
    # Half-even rounding, as the positions are defined.
    cuts = sorted({round(min_train + i * span) for i in range(steps)})
    return df.sparkSession.createDataFrame(
        [(i, int(years[c - 1])) for i, c in enumerate(cuts, 1)], schema)


def last_year_folds(df: DataFrame, n: int = 3, year: str = YEAR) -> DataFrame:
    """Fold table (fold, test_yr) of the last years; train on the years before."""
    years = distinct_years(df, year)
    picked = years[-min(n, len(years) - 2):] if len(years) > 2 else []
    return df.sparkSession.createDataFrame(
        [(i, int(y)) for i, y in enumerate(picked, 1)], "fold int, test_yr int")


def fold_rows(df: DataFrame, folds: DataFrame, year: str = YEAR) -> DataFrame:
    """Row counts per fold and part, from counts per year."""
    per_year = df.groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    cut = "cut_yr" if "cut_yr" in folds.columns else "test_yr"
    val = F.col(year) > F.col(cut) if cut == "cut_yr" else F.col(year) == F.col(cut)
    train = F.col(year) <= F.col(cut) if cut == "cut_yr" else F.col(year) < F.col(cut)
    table = [(r["fold"], r[cut]) for r in folds.collect()]
    spine = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(c).alias(cut)) for f, c in table])
    return (per_year.select("*", F.inline(spine)).groupBy("fold", cut).agg(
        F.sum(F.when(train, F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(val, F.col("n")).otherwise(0)).alias("n_val")))


def year_weights(df: DataFrame, weights: Mapping[int, float], default: float = 1.0,
                 year: str = YEAR, out: str = "weight") -> DataFrame:
    rules = [(F.col(year) == y, float(w)) for y, w in weights.items()]
    return df.withColumn(out, first_match(rules, float(default)))


# -- frames ------------------------------------------------------------------

def training_frames(panel: DataFrame, target: str, key: str = KEY, year: str = YEAR,
                    from_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Delta and level frames for one value column.

    The delta frame drops level drivers (`_lvl`), the level frame growth drivers
    (`_yoy`).
    """
    rows = panel if from_year is None else panel.filter(F.col(year) > from_year)
    w = Window.partitionBy(key).orderBy(year)
    log = f"log_{target}"
    base = rows.withColumn(log, log_pos(target))
    base = base.withColumns({f"{log}_lag1": F.lag(log, 1).over(w),
                             f"{log}_lag2": F.lag(log, 2).over(w)})
    base = base.withColumn(f"delta_{log}", F.col(log) - F.col(f"{log}_lag1"))
    delta = drop_like(drop_null(base, [log, f"{log}_lag1"]), "_lvl")
    level = drop_like(drop_null(base, [log]), "_yoy")
    return delta, level


def numeric_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row count, known values, minimum and maximum per column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        value = F.col(c).cast("double")
        aggs += [F.struct(F.count(c).alias("n"), F.min(value).alias("lo"),
                          F.max(value).alias("hi")).alias(c)]
    row = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols])
    return row.select("n_rows", F.inline(each)).select(
        "feature", "n_rows", F.col("s.n").alias("n_known"), "s.lo", "s.hi")


def dead_pattern(names: Sequence[str] = codes.DEAD_SERIES, prefix: str = "cs_[a-z]+_") -> str:
    """Pattern of market features that have no values in the forecast years."""
    return f"^{prefix}({'|'.join(names)})$"


def screen_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                    max_null: float = 0.5, max_levels: int = 200, dead: str | None = None,
                    min_known: int = 0) -> DataFrame:
    """One row per feature with `keep` and the reason it was dropped.

    A numeric feature is constant when its minimum is its maximum. Levels of
    categorical features are counted as distinct (feature, level) pairs.
    """
    stats = numeric_stats(df, numeric)
    share_null = 1 - F.col("n_known") / F.col("n_rows")
    rules = [(F.col("feature").rlike(dead), "no_coverage")] if dead else []
    rules += [(F.col("n_known") < max(min_known, 1), "too_few"),
              (F.col("lo") == F.col("hi"), "constant"),
              (share_null > max_null, "mostly_null")]
    out = stats.select("feature", "n_rows", "n_known", F.lit(None).cast("long").alias("n_levels"),
                       first_match(rules, F.lit(None).cast("string")).alias("reason"))
    if categorical:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
            [], list(categorical), "feature", "level")
        per_level = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
        levels = per_level.groupBy("feature").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))),
                       F.lit(0)).alias("n_known"),
            F.count("level").alias("n_levels"))
        why = first_match([(F.col("n_levels") < 2, "single_level"),
                           (F.col("n_levels") > max_levels, "many_levels"),
                           (share_null > max_null, "mostly_null")],
                          F.lit(None).cast("string"))
        out = out.unionByName(levels.select("feature", "n_rows", "n_known", "n_levels",
                                            why.alias("reason")))
    return out.withColumn("keep", F.col("reason").isNull())


def kept_features(screened: DataFrame) -> list[str]:
    return sorted(r[0] for r in screened.filter("keep").select("feature").collect())


def subgroup_frames(panel: DataFrame, features: Sequence[str], key: str = KEY,
                    year: str = YEAR, cap: float = 1.0, min_rows: int = 100,
                    min_known: int = 50) -> dict[str, tuple[DataFrame, list[str]]]:
    """Delta and level frames for land and improvements of one subgroup.

    Wild changes (|dlog| above `cap`) are trimmed, features need enough known and
    more than one distinct value, and frames with too few rows are skipped. The lagged rows are kept;
    one aggregate over them gives the features' statistics and all sizes, and the frames are filters.
    """
    w = Window.partitionBy(key).orderBy(year)
    logs = {"land": log_pos("appr_land_val"), "impr": log_pos("appr_imps_val")}
    base = panel.withColumns({f"log_{k}": v for k, v in logs.items()})
    # Lags carry the names under which a forecast offers them.
    lags = {"land": "log_land", "impr": "log_imps"}
    base = base.withColumns({f"{c}_lag{n}": F.lag(f"log_{k}", n).over(w)
                             for k, c in lags.items() for n in (1, 2)})
    base = base.withColumns({f"dlog_{k}": F.col(f"log_{k}") - F.col(f"{c}_lag1")
                             for k, c in lags.items()})
    # Statistics, sizes and frames all read these rows, so they are computed once.
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    wanted = {}
    for k in logs:
        wanted[f"{k}_delta"] = (f"dlog_{k}", F.abs(f"dlog_{k}") <= cap)
        wanted[f"{k}_level"] = (f"log_{k}", F.col(f"log_{k}").isNotNull())
    lagged = [*features, *[f"{c}_lag{n}" for c in lags.values() for n in (1, 2)]]
    value = {c: F.col(c).cast("double") for c in lagged}
    row = base.agg(*[F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"_of_{c}")
                     for c, v in value.items()],
                   *[F.count_if(mask).alias(f"_rows_{n}") for n, (_, mask) in wanted.items()]).first().asDict(True)
    known = {c: row[f"_of_{c}"] for c in lagged}
    used = sorted(c for c, s in known.items() if s["n"] >= max(min_known, 1) and s["lo"] != s["hi"])
    return {n: (base.filter(mask).select(key, year, target, *used), used)
            for n, (target, mask) in wanted.items() if row[f"_rows_{n}"] > min_rows}


# -- imputing and levels -----------------------------------------------------

def fit_imputer(train: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact training medians of the numeric features; none for a feature without values."""
    return {c: m for c, m in medians(train, numeric).items() if m is not None}


def apply_imputer(df: DataFrame, medians: Mapping[str, float],
                  categorical: Sequence[str] = (), unknown: str = "Unknown") -> DataFrame:
    """Fill with the training medians; a feature without one is 0."""
    out = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in medians.items()
           if c in df.columns}
    out |= {c: F.coalesce(F.col(c).cast("string"), F.lit(unknown)) for c in categorical
            if c in df.columns}
    return df.withColumns(out)


def lump_levels(df: DataFrame, c: str, min_rows: int = 500, other: str = "Other") -> DataFrame:
    """Levels with fewer rows than `min_rows` become one level; NULL stays."""
    common = (df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
              .filter((F.col("_n") >= min_rows) & F.col(c).isNotNull()).drop("_n")
              .withColumn("_common", F.lit(True)))
    lumped = (F.when(F.col("_common"), F.col(c))
              .when(F.col(c).isNotNull(), F.lit(other)))
    return df.join(common, c, "left").withColumn(c, lumped).drop("_common")


# -- training and scoring ----------------------------------------------------

@dataclass(frozen=True)
class FittedModel:
    """A fitted pipeline and what scoring needs to feed it."""

    pipeline: PipelineModel
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: Mapping[str, float]
    cv_rmse: float | None
    n_trees: int

    def save(self, path: str) -> str:
        """Write the model below `path`: the pipeline and one row of what scoring needs."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        row = (self.target, list(self.numeric), list(self.categorical),
               {k: float(v) for k, v in self.medians.items()}, self.cv_rmse, self.n_trees)
        spark.createDataFrame([row], _MODEL_SCHEMA).write.mode("overwrite").parquet(f"{path}/model")
        return path

    def publish(self, root: str) -> str:
        """Save as the newest version below `root`."""
        return publish(SparkSession.active(), root, self.save).path

    @staticmethod
    def latest(root: str) -> FittedModel:
        """The version that was published last."""
        version = current(SparkSession.active(), root)
        if version is None:
            raise ValueError(f"no model is published below {root}")
        return FittedModel.load(version.path)

    @staticmethod
    def load(path: str) -> FittedModel:
        row = SparkSession.active().read.parquet(f"{path}/model").first()
        return FittedModel(PipelineModel.load(f"{path}/pipeline"), row["target"], tuple(row["numeric"]),
                           tuple(row["categorical"]), row["medians"], row["cv_rmse"], row["n_trees"])


_MODEL_SCHEMA = ("target string, numeric array<string>, categorical array<string>, "
                 "medians map<string,double>, cv_rmse double, n_trees int")


@dataclass(frozen=True)
class _Boosting:
    """Settings of the trees, and the steps before them."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str
    weight: str | None
    step: float
    depth: int
    min_leaf: int
    #: Trees that are added to an ensemble at once; the first of them is not shrunk by `step`.
    chunk: int
    #: Partitions of the rows that trees are fitted to, at most.
    parts: int

    def before(self, train: DataFrame) -> PipelineModel:
        """Level codes and the feature vector."""
        indexed = [f"{c}_index" for c in self.categorical]
        stages = [StringIndexer(inputCols=list(self.categorical), outputCols=indexed,
                                handleInvalid="keep")] if self.categorical else []
        return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*self.numeric, *indexed],
                                                         outputCol="features")]).fit(train)

    def trees(self, n: int, out: str = "_part") -> GBTRegressor:
        gbt = GBTRegressor(labelCol=_LEFT, predictionCol=out, maxIter=n, stepSize=self.step, subsamplingRate=0.8,
                           featureSubsetStrategy="0.8", seed=123, maxBins=256, maxDepth=self.depth,
                           minInstancesPerNode=self.min_leaf)
        return gbt.setWeightCol(self.weight) if self.weight else gbt

    def ready(self, before: PipelineModel, rows: DataFrame) -> DataFrame:
        """Features, weight and what is left to explain: at first the target itself."""
        cols = ["features", F.col(self.target).cast("double").alias(_LEFT)]
        return before.transform(rows).select(*cols, *([self.weight] if self.weight else [])).coalesce(self.parts)


_LEFT = "_left"  # the residual that the next trees are fitted to

#: Values in a partition of training rows.
_CELLS = 1 << 18
#: Values in a partition of rows that trees are fitted to: at least, until every core has one, and at most.
_FILL, _MOST = 1 << 21, 1 << 23
#: Values of the training rows that are fitted to at the same time, by all folds and models together.
_HELD = 1 << 26


def _parts_for(rows: int, columns: int) -> int:
    """Partitions for training rows, by their size."""
    return max(1, -(-rows * columns // _CELLS))


def _tree_parts(rows: int, columns: int, cores: int, fill: int) -> int:
    """Partitions for the rows that trees are fitted to.

    Each level of each tree is a job over all partitions with a shuffle between as many tasks, so more
    of them than cores would cost more than the rows in them; a partition's size is bounded all the same.
    """
    cells = rows * columns
    return max(1, min(cores, -(-cells // fill)), -(-cells // _MOST))


class _Room:
    """Lets in what fits beside the others, and alone what does not fit at all."""

    def __init__(self):
        self._held, self._free = 0, Condition()

    @contextmanager
    def of(self, cells: int):
        with self._free:
            self._free.wait_for(lambda: not self._held or self._held + cells <= _HELD)
            self._held += cells
        try:
            yield
        finally:
            with self._free:
                self._held -= cells
                self._free.notify_all()


_ROOM = _Room()


def _explained(rows: DataFrame, booster) -> DataFrame:
    """The residuals after a booster's trees, kept for the next ones."""
    after = booster.transform(rows)
    return (after.withColumn(_LEFT, F.col(_LEFT) - F.col(booster.getPredictionCol())).select(*rows.columns)
            .persist(StorageLevel.MEMORY_AND_DISK))


def _best_size(train: DataFrame, later: DataFrame, boosting: _Boosting, patience: int,
               max_trees: int) -> tuple[int, float]:
    """Trees with the least squared error on the later rows, and the root of that error.

    The ensemble grows by a chunk of trees fitted to the residuals of those before, so no tree is
    fitted twice; it is long enough when `patience` trees after the best one bring nothing.
    """
    before = boosting.before(train)
    left, ahead = (boosting.ready(before, rows).persist(StorageLevel.MEMORY_AND_DISK) for rows in (train, later))
    errors: list[float] = []
    while True:
        booster = boosting.trees(min(boosting.chunk, max_trees - len(errors))).fit(left)
        errors += booster.evaluateEachIteration(ahead, "squared")
        best = min(range(len(errors)), key=errors.__getitem__)
        enough = best + 1 + patience <= len(errors) or len(errors) >= max_trees
        grown = None if enough else [_explained(rows, booster) for rows in (left, ahead)]
        if enough:
            left.unpersist()
            ahead.unpersist()
            return best + 1, errors[best] ** 0.5
        for row in grown:
            row.count()  # before the rows they come from are let go
        left.unpersist()
        ahead.unpersist()
        left, ahead = grown


def _fit_trees(rows: DataFrame, boosting: _Boosting, trees: int) -> PipelineModel:
    """A pipeline of `trees` trees, grown by the same chunks as in the search for their number."""
    before = boosting.before(rows)
    left, parts = boosting.ready(before, rows).persist(StorageLevel.MEMORY_AND_DISK), []
    while trees > 0:
        parts.append(boosting.trees(min(boosting.chunk, trees), f"_part{len(parts)}").fit(left))
        trees -= boosting.chunk
        if trees > 0:
            grown = _explained(left, parts[-1])
            grown.count()
            left.unpersist()
            left = grown
    left.unpersist()
    total = " + ".join(f"_part{i}" for i in range(len(parts)))
    return PipelineModel([*before.stages, *parts,
                          SQLTransformer(statement=f"SELECT *, {total} AS prediction FROM __THIS__")])


def fit_model(frame: DataFrame, target: str, numeric: Sequence[str],
              categorical: Sequence[str] = (), folds: Sequence[int] = (), year: str = YEAR,
              max_trees: int = 2000, patience: int = 50, step: float = 0.05, depth: int = 6,
              min_leaf: int = 50, weight: str | None = None, parallelism: int = 5) -> FittedModel:
    """Cross-validated size, then one fit of the mean size on all rows.

    `folds` are cut years: each fold trains up to its cut, medians and levels included, and
    takes the size with the least error on the later years, sought until `patience` further
    trees bring nothing. Without folds the size is `max_trees`. Up to `parallelism` folds are
    searched at the same time, fewer where their rows would not fit; they share nothing but the frame.
    """
    categorical = tuple(categorical)
    # Every fold reads the frame again, so what it needs of it is kept while fitting. Every job over its rows
    # carries their lineage to its tasks, which is cut for that.
    used = dict.fromkeys([*([year] if folds else []), target, *numeric, *categorical, *([weight] if weight else [])])
    whole = frame.persist(StorageLevel.MEMORY_AND_DISK)  # counted first, as its size says how many files it takes
    rows, columns = whole.count(), len(numeric) + len(categorical) + 2
    shared_dir(frame.sparkSession)
    frame = whole.coalesce(_parts_for(rows, columns)).select(*used).checkpoint()
    whole.unpersist()
    parts = partial(_tree_parts, rows, columns, frame.sparkSession.sparkContext.defaultParallelism)

    def settings(known: Sequence[str], parts: int) -> _Boosting:
        return _Boosting(tuple(known), categorical, target, weight, step, depth, min_leaf,
                         max(20, patience + patience // 5), parts)

    def search(cut: int) -> tuple[int, float] | None:
        early, late = (frame.filter(c) for c in (F.col(year) <= cut, F.col(year) > cut))
        medians_ = fit_imputer(early, numeric)
        known = [c for c in numeric if c in medians_]
        if not known or late.isEmpty():
            return None
        with _ROOM.of(rows * columns):
            return _best_size(apply_imputer(early, medians_, categorical), apply_imputer(late, medians_, categorical),
                              settings(known, parts(_FILL)), patience, max_trees)

    found = [r for r in _at_once(parallelism, frame.sparkSession, [partial(search, cut) for cut in folds]) if r]
    medians_ = fit_imputer(frame, numeric)
    known = tuple(c for c in numeric if c in medians_)
    trees = max(1, round(sum(n for n, _ in found) / len(found))) if found else max_trees
    with _ROOM.of(rows * columns):
        # One fit instead of one for each fold, so a core gets a smaller share.
        final = _fit_trees(apply_imputer(frame, medians_, categorical), settings(known, parts(_FILL // 4)), trees)
    return FittedModel(final, target, known, categorical, medians_,
                       sum(e for _, e in found) / len(found) if found else None, trees)


def _at_once(most: int, spark: SparkSession, tasks: Sequence[Callable]) -> list:
    """What the tasks return; up to `most` of them run at the same time."""
    own = [inheritable_thread_target(spark)(task) for task in tasks]
    if not own:
        return []
    with ThreadPoolExecutor(min(most, len(own))) as pool:
        return list(pool.map(lambda task: task(), own))


def fit_delta_level(frames: Mapping[str, tuple[DataFrame, Sequence[str]]],
                    targets: Mapping[str, str], at_once: int = 4, **options) -> dict[str, FittedModel]:
    """One model per frame, such as `land_delta` and `land_level`; up to `at_once` are fitted at the same time."""
    fits = [partial(fit_model, frame, targets[name], features, **options)
            for name, (frame, features) in frames.items()]
    spark = next((frame.sparkSession for frame, _ in frames.values()), None)
    return dict(zip(frames, _at_once(at_once, spark, fits)))


def score(df: DataFrame, model: FittedModel, out: str = "prediction",
          allow_absent: Sequence[str] = ()) -> DataFrame:
    """Add the prediction; NULL features take the training medians.

    A feature that is no column of `df` is an error, unless `allow_absent` lists it.
    """
    gone = [c for c in model.numeric + model.categorical if c not in df.columns and c not in allow_absent]
    if gone:
        raise ValueError(f"features are absent: {', '.join(gone)}")
    absent = {c: F.lit(None).cast("double") for c in model.numeric if c not in df.columns}
    absent |= {c: F.lit(None).cast("string") for c in model.categorical if c not in df.columns}
    # Work on copies so that the caller's own NULLs are kept.
    keep = [c for c in df.columns if c != out]
    base = df.withColumns({f"_keep_{c}": F.col(c) for c in model.numeric + model.categorical
                           if c in df.columns})
    ready = apply_imputer(base.withColumns(absent), model.medians, model.categorical)
    scored = model.pipeline.transform(ready.drop("prediction", "features", *[
        c for c in ready.columns if c.startswith("_part")]))
    restored = [F.col(f"_keep_{c}").alias(c) if f"_keep_{c}" in base.columns else F.col(c)
                for c in keep]
    return scored.select(*restored, F.col("prediction").alias(out))


def importance_by_family(model: FittedModel, spark, families=codes.IMPORTANCE_FAMILIES,
                         top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Gain by feature family, and the top features of each family."""
    names = [*model.numeric, *model.categorical]
    # Parts of an ensemble weigh by their trees; together the gains are 1.
    parts = [s for s in model.pipeline.stages if hasattr(s, "featureImportances")]
    sizes = [p.getNumTrees for p in parts]
    gains = sum(p.featureImportances.toArray() * n for p, n in zip(parts, sizes)) / sum(sizes)
    table = spark.createDataFrame(list(zip(names, map(float, gains))),
                                  "feature string, gain double")
    table = table.withColumn("family", first_match(
        [(F.col("feature").rlike(p), f) for p, f in families], "entity"))
    summary = table.groupBy("family").agg(
        F.sum("gain").alias("total_gain"), F.count(F.lit(1)).alias("n_features"),
        F.avg("gain").alias("avg_gain"))
    return summary, top_n(table, "family", [F.desc("gain"), "feature"], top)


# -- retrofit, extension, hold-out -------------------------------------------

def retrofit(panel: DataFrame, land_level=None, impr_delta=None, impr_level=None,
             key: str = KEY, year: str = YEAR) -> DataFrame:
    """Fill missing history: land by level, improvements by delta or else level.

    The models are functions (frame, name) -> frame with the prediction in column
    `name`. Rows marked `is_land_only` keep improvements of 0.
    """
    w = Window.partitionBy(key).orderBy(year)
    out = panel.withColumns({"log_appr_land_val": log_pos("appr_land_val"),
                             "log_appr_imps_val": log_pos("appr_imps_val")})
    out = out.withColumn("log_appr_imps_val_lag1", F.lag("log_appr_imps_val").over(w))
    null = F.lit(None).cast("double")
    for name, scorer in (("_land", land_level), ("_delta", impr_delta), ("_level", impr_level)):
        out = scorer(out, name) if scorer else out.withColumn(name, null)
    land_only = F.coalesce(F.col("is_land_only") == 1, F.lit(False))
    log_impr = F.coalesce(F.col("log_appr_imps_val_lag1") + F.col("_delta"), F.col("_level"))
    observed = F.when(F.col("appr_imps_val") > 0, F.col("appr_imps_val")).cast("double")
    out = out.withColumns({
        "pred_log_land": F.when(F.col("log_appr_land_val").isNull(), F.col("_land")),
        "pred_log_impr": F.when(F.col("log_appr_imps_val").isNull() & ~land_only, log_impr)})
    out = out.withColumns({
        "appr_land_val_filled": F.coalesce(F.exp("pred_log_land"),
                                           F.col("appr_land_val").cast("double")),
        "appr_imps_val_filled": F.when(land_only, F.lit(0.0)).otherwise(
            F.coalesce(observed, F.exp("pred_log_impr")))})
    total = F.col("appr_land_val_filled") + F.col("appr_imps_val_filled")
    return out.withColumns({"total_assessed_filled": total,
                            "log_total_assessed_filled": log_pos(total)}
                           ).drop("_land", "_delta", "_level")


def retrofit_carry(panel: DataFrame, cols: Sequence[str], key: str = KEY,
                   year: str = YEAR) -> DataFrame:
    return fill_both(panel, key, year, cols)


def extend_panel(history: DataFrame, years: Sequence[int], drivers: DataFrame | None = None,
                 state: str = "last_row", targets: Sequence[str] = (),
                 advance: Sequence[str] = (), last_year: int | None = None, key: str = KEY,
                 year: str = YEAR, overlay: bool = False, scenario: str | None = None) -> DataFrame:
    """History and one row per entity and future year.

    The state is each entity's last row, or its row in the last year
    (`state="last_year"`). Targets are NULL, `advance` columns grow by the years
    since the last year of the history (found in the plan unless it is given),
    drivers replace their old columns. With `overlay` a driver that is NULL keeps the
    entity's last value. With `scenario`, a column of the drivers, a future year has a row for each of
    its scenarios; the history is kept once, with a NULL scenario (see `forecast_sequential`).
    """
    if state not in ("last_row", "last_year"):
        raise ValueError(f"state must be 'last_row' or 'last_year', not {state!r}")
    last = F.lit(last_year) if last_year is not None else history.agg(F.max(year)).scalar()
    base = (last_row(history, key, [year]) if state == "last_row"
            else history.filter(F.col(year) == last))
    future = expand_snapshot(base, years, year)
    types = dict(history.dtypes)
    future = future.withColumns(
        {c: F.lit(None).cast(types[c]) for c in targets if c in types}
        | {c: (F.col(c) + (F.col(year) - last)).cast(types[c]) for c in advance})
    if drivers is not None:
        old = {c: f"_old_{c}" for c in drivers.columns if overlay and c != year and c in future.columns}
        future = future.withColumns({v: F.col(c) for c, v in old.items()})
        if scenario is None:
            future = attach_drivers(future, drivers, on=year)
        else:
            # One row per year with its scenarios in an array, made rows last.
            cols = [c for c in drivers.columns if c != year]
            paths = drivers.groupBy(year).agg(F.array_sort(F.collect_list(F.struct(
                scenario, *[c for c in cols if c != scenario]))).alias("_paths"))
            future = attach_drivers(future.drop(*cols), paths, on=year)
            future = future.select("*", F.inline_outer("_paths")).drop("_paths")
        future = future.withColumns({c: F.coalesce(c, v) for c, v in old.items()}).drop(*old.values())
    return stack([history, future])


def evaluate_holdout(panel: DataFrame, holdout: int, value: str, scorer, by: Sequence[str] = (),
                     key: str = KEY, year: str = YEAR) -> tuple[DataFrame, DataFrame]:
    """Error metrics for one year, and actual against predicted totals.

    Rows need a positive value in the year and in the row before.
    """
    w = Window.partitionBy(key).orderBy(year)
    rows = panel.withColumn("log_actual", log_pos(value))
    rows = rows.withColumns({"log_lag1": F.lag("log_actual", 1).over(w),
                             "log_lag2": F.lag("log_actual", 2).over(w)})
    rows = rows.filter((F.col(year) == holdout) & F.col("log_actual").isNotNull()
                       & F.col("log_lag1").isNotNull())
    scored = scorer(rows, "_delta").withColumn("log_pred", F.col("log_lag1") + F.col("_delta"))
    totals = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.exp("log_actual")).alias("actual"),
        F.sum(F.exp("log_pred")).alias("predicted"))
    totals = totals.withColumn("gap_pct", growth("predicted", "actual"))
    return error_metrics(scored, "log_actual", "log_pred", by), totals
