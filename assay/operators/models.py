"""Explanatory models: feature importance, segments, anomalies, forecasts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import add_totals, col, month_of, ratio, unpivot
from assay.functions.forest import grow_tree, scores
from assay.functions.holt import holt_forecast
from assay.functions.orderstats import LIMIT, quantile_row
from assay.operators.profiling import as_double
from assay.session import PART_ROWS, cut_lineage, keep

SEED = 42
MAX_DEPTH = 30          # as deep as Spark's trees go
STARTS, ITERATIONS = 10, 300
POOL, TOLERANCE = 10_000, 1e-4     # rows that first centres are drawn from; squared movement of centres at rest
CELL, HELD = 256, 1 << 19          # points of a cell, and those that a task sorts into cells at once
CELLS, TOGETHER = 2048, 64         # cells that are looked at together, and those whose points are
MIN_ROWS_REGRESSION = MIN_ROWS_SEGMENTS = 30
MIN_ROWS_ANOMALY = 50
MIN_MONTHS = 12
MAX_SEGMENTS = 6
TREES, SAMPLE = 100, 256
BAG = 1 << 29           # bytes of rows with their counts in all trees that one task of a forest reads
CONTAMINATION = 0.05
COVERAGE = 0.70
FORECAST_MONTHS = 3


def covered_columns(df: DataFrame, columns: list[str], share: float = COVERAGE) -> list[str]:
    """Those of the columns with a value in at least 70 % of the rows."""
    columns = [c for c in columns if not c.startswith("__")]
    if not columns:
        return []
    row = df.agg(*[ratio(F.count(as_double(df, c)), F.count("*")) for c in columns]).first()
    return [c for c, v in zip(columns, row) if v is not None and v >= share]


def _complete(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """The columns as doubles (with key columns), rows with a gap left out."""
    out = df.select(*[col(k) for k in keys], *[as_double(df, c).alias(c) for c in columns])
    return out.filter(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in columns]))


def _vector(columns: list[str]) -> Column:
    return array_to_vector(F.array(*[col(c) for c in columns]))


# --- feature importance ------------------------------------------------------------------------------

def _spread(rows: DataFrame, most: int, least: int = PART_ROWS) -> tuple[DataFrame, int]:
    """The rows kept, and their number. They are dealt out anew if a task would read more than ``most`` of them,
    or more than twice a core's share of what makes ``least`` rows a task."""
    kept = keep(rows)
    sizes = kept.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("n"), F.max("count").alias("largest")).first()
    n = sizes["n"] or 0
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, n // least)
    if not n or sizes["largest"] <= most and sizes["largest"] * parts <= 2 * n:
        return kept, n
    kept.unpersist()
    return keep(rows.repartition(max(-(-n // most), parts))), n


def feature_importance(df: DataFrame, target: str, features: list[str], trees: int = TREES,
                       max_depth: int = MAX_DEPTH, seed: int = SEED, bag: int = BAG) -> DataFrame:
    """Importance of each feature in a random forest for the target, with in-sample R squared.

    Needs 30 complete rows, else no rows come back. Trees grow to ``max_depth``; ask for less where
    the work per level matters more than the last leaves. A forest holds each row with its count in every
    tree, so rows are dealt to tasks of about ``bag`` bytes of that.
    """
    schema = "feature string, importance double, importance_pct double, r_squared double, n_rows bigint"
    features = [f for f in features if f != target]
    data = _complete(df, [target, *features])
    vectors, n = _spread(data.select(_vector(features).alias("features"), col(target).alias("label")),
                         max(1, bag // (4 * trees + 8 * len(features) + 96)))
    try:
        if n < MIN_ROWS_REGRESSION:
            return df.sparkSession.createDataFrame([], schema)
        forest = RandomForestRegressor(numTrees=trees, maxDepth=max_depth, seed=seed,
                                       cacheNodeIds=False).fit(vectors)
        y, p = F.col("label"), F.col("prediction")
        fit = forest.transform(vectors).agg(
            F.sum((y - p) * (y - p)).alias("rest"), (F.var_pop("label") * F.count("*")).alias("all")
        ).first()
    finally:
        vectors.unpersist()
    r2 = 1 - fit["rest"] / fit["all"] if fit["all"] else 0.0
    importances = forest.featureImportances.toArray()
    rows = [(f, float(w), float(w) * 100, float(r2), n) for f, w in zip(features, importances)]
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.col("importance").desc(), "feature")


# --- segments -----------------------------------------------------------------------------------------

@dataclass
class Segments:
    """A chosen clustering: rows with their segment, and the figures it was chosen by."""

    columns: list[str]
    k: int
    silhouette: float
    assigned: DataFrame
    centres: np.ndarray     # in standardised units
    cost: float             # squared standardised distances to the nearest centre, all rows


def first_centres(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the points, each drawn in proportion to its squared distance from those drawn before."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.integers(len(points))]]
    apart = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        at = rng.choice(len(points), p=apart / apart.sum()) if apart.sum() > 0 else rng.integers(len(points))
        chosen.append(points[at])
        apart = np.minimum(apart, ((points - points[at]) ** 2).sum(axis=1))
    return np.array(chosen)


def _points(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return pc.list_flatten(batch.column("features")).to_numpy(zero_copy_only=False).reshape(-1, size)


def _nearest(x: np.ndarray, fits: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fit, place of the nearest centre, squared distance) of each point; the first of equals."""
    centres = np.concatenate(list(fits.values()))
    lengths = (x ** 2).sum(axis=1)
    apart = (centres ** 2).sum(axis=1) - 2 * x @ centres.T
    start = 0
    for f, own in fits.items():
        part = apart[:, start:start + len(own)]
        at = part.argmin(axis=1)
        yield f, at, np.maximum(part[np.arange(len(x)), at] + lengths, 0)
        start += len(own)


def cell_order(x: np.ndarray) -> np.ndarray:
    """An order of the points in which each run of ``CELL`` lies close together: halved along the widest axis."""
    order, parts = np.arange(len(x)), [(0, len(x))]
    while parts:
        low, high = parts.pop()
        half = -(-(high - low) // CELL) // 2 * CELL
        if half:
            own = x[order[low:high]]
            axis = np.ptp(own, axis=0).argmax()
            order[low:high] = order[low:high][np.argpartition(own[:, axis], half)]
            parts += [(low, low + half), (low + half, high)]
    return order


def _cells(points: DataFrame, size: int) -> DataFrame:
    """The points written once in cells: (n, points by axis, facts: low and high end, n, squared length, sum)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_points(batch, size))
            n += len(held[-1])
            if n >= HELD:
                yield from sort(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from sort(np.concatenate(held))

    def sort(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = x[cell_order(x)]
        parts = [x[at:at + CELL] for at in range(0, len(x), CELL)]
        facts = [np.r_[p.min(axis=0), p.max(axis=0), len(p), (p ** 2).sum(), p.sum(axis=0)] for p in parts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(p) for p in parts], pa.int64()), pa.array([p.T.tobytes() for p in parts], pa.binary()),
             pa.array([f.tobytes() for f in facts], pa.binary())], names=["n", "points", "facts"])

    rows, cores = points.select("features"), points.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a small table lies in one file, and each round would be one task
        rows = rows.repartition(cores)
    return cut_lineage(rows.mapInArrow(pack, "n long, points binary, facts binary"))


def undivided(facts: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the centre nearest to its middle, and whether that is nearest to all of its box.

    Where x is how much nearer to one centre than to another is linear in x, so it is least in a corner.
    Boxes that come close to a border count as divided.
    """
    k, size = centres.shape
    low, high = facts[:, :size], facts[:, size:2 * size]
    middle, reach = (low + high) / 2, (high - low) / 2
    lengths = (centres ** 2).sum(axis=1)
    apart = lengths - 2 * middle @ centres.T
    at = apart.argmin(axis=1)
    rows = np.arange(len(at))
    between = np.abs(centres[:, None] - centres[None]).reshape(k * k, size)
    swing = 2 * (reach @ between.T).reshape(-1, k, k)[rows, at]
    margin = 1e-9 * (1 + lengths.max() + (middle ** 2).sum(axis=1) + (reach ** 2).sum(axis=1))
    clear = apart[rows, at][:, None] - apart + swing < -margin[:, None]
    clear[rows, at] = True
    return at, clear.all(axis=1)


def _point_sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(n, squared length, sums) of each centre's points, from cells of (1, squared length, point by axis)."""
    apart = (centres ** 2).sum(axis=1)[:, None] - 2 * np.matmul(centres, x[:, 2:])
    best, at = apart[:, 0].copy(), np.zeros((len(x), x.shape[2]), np.int8)
    for j in range(1, len(centres)):
        other = apart[:, j]
        np.putmask(at, other < best, j)
        np.minimum(best, other, out=best)
    member = (at[:, None] == np.arange(len(centres), dtype=np.int8)[:, None]).astype(np.float64)
    return np.matmul(member, x.transpose(0, 2, 1)).sum(axis=0)


def _add_cells(x: np.ndarray, facts: np.ndarray, fits: dict[int, np.ndarray], total: dict[int, np.ndarray]) -> None:
    """Adds cells of equal size: undivided ones by their facts, the points of all others one by one."""
    size = x.shape[1]
    x = np.concatenate([np.ones_like(x[:, :1]), (x ** 2).sum(axis=1, keepdims=True), x], axis=1)
    for f, centres in fits.items():
        at, whole = undivided(facts, centres)
        member = (at[whole] == np.arange(len(centres))[:, None]).astype(np.float64)
        total[f] += member @ facts[whole, 2 * size:]
        divided = np.flatnonzero(~whole)
        for low in range(0, len(divided), TOGETHER):
            total[f] += _point_sums(x[divided[low:low + TOGETHER]], centres)


def _cluster_sums(cells: DataFrame, fits: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One scan for all fits: (n, cost, sum of squared lengths, sums of the components) per cluster."""
    size = next(iter(fits.values())).shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros((len(c), 2 + size)) for f, c in fits.items()}
        for batch in batches:
            n = batch.column("n").to_numpy()
            for count in np.unique(n):
                some = np.flatnonzero(n == count)
                for low in range(0, len(some), CELLS):
                    part = batch.take(pa.array(some[low:low + CELLS]))
                    x, facts = (np.frombuffer(b"".join(part.column(c).to_pylist())) for c in ("points", "facts"))
                    _add_cells(x.reshape(-1, size, count), facts.reshape(len(part), -1), fits, total)
        places = [(f, c) for f, t in total.items() for c in range(len(t))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in places], pa.int64()), pa.array([c for _, c in places], pa.int64()),
             pa.array([total[f][c].tolist() for f, c in places], pa.list_(pa.float64()))], names=["fit", "cluster", "sums"])

    found = cells.mapInArrow(sums, "fit long, cluster long, sums array<double>")
    rows = found.groupBy("fit", "cluster").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 + size)]).collect()
    out = {f: np.zeros((len(c), 3 + size)) for f, c in fits.items()}
    for r in rows:  # a row for each centre
        n, length, *total = (r[f"s{i}"] for i in range(2 + size))
        centre = fits[r["fit"]][r["cluster"]]
        out[r["fit"]][r["cluster"]] = [n, max(length - 2 * centre @ total + n * (centre @ centre), 0.0), length, *total]
    return out


def _silhouettes(points: DataFrame, fits: dict[int, np.ndarray], sums: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette of each fit in one scan, from squared distances and cluster sums."""
    size = next(iter(fits.values())).shape[1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = dict.fromkeys(fits, 0.0), 0
        for batch in batches:
            x = _points(batch, size)
            n += len(x)
            for f, at, _ in _nearest(x, fits):
                count = np.maximum(sums[f][:, 0], 1)
                apart = ((x ** 2).sum(axis=1)[:, None] + sums[f][:, 2] / count - 2 * x @ (sums[f][:, 3:] / count[:, None]).T)
                apart[:, sums[f][:, 0] == 0] = np.inf
                here = np.arange(len(x)), at
                own = apart[here] * count[at] / np.maximum(count[at] - 1, 1)
                apart[here] = np.inf
                other = apart.min(axis=1)
                score = np.where(count[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
                total[f] += score.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64()),
             pa.array([n] * len(total), pa.int64())], names=["fit", "score", "n"])

    rows = points.select("features").mapInArrow(judge, "fit long, score double, n long").groupBy("fit").agg(
        (F.sum("score") / F.sum("n")).alias("score")).collect()
    return {r["fit"]: r["score"] for r in rows}


def fit_segments(df: DataFrame, columns: list[str], *keys: str, seed: int = SEED, starts: int = STARTS,
                 iterations: int = ITERATIONS) -> Segments | None:
    """K-means on standardised columns, k from 2 to 6 by best silhouette; None if not enough data.

    Each k is fitted from ``starts`` beginnings and the fit with the smallest cost stays. All fits move
    together: one scan a round adds up every fit's clusters, and a fit is left out once its centres
    rest, so 50 fits take as many scans as the slowest of them. Points are written in cells that lie
    close together; a cell whose box lies on one centre's side is added as a whole. First centres are drawn from the
    ``POOL`` rows with the smallest hash, the same rows whatever the partitioning; everything after
    that sees all rows. A centre without rows stays where it is.

    The silhouette uses squared distances and cluster sums, so it is linear in the rows.
    """
    columns = covered_columns(df, columns)
    if len(columns) < 2:
        return None
    data = _complete(df, columns, *keys)
    facts = data.agg(F.count("*").alias("n"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                     *[F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    n = facts["n"]
    if n < MIN_ROWS_SEGMENTS:
        return None
    parts = [(col(c) - facts[f"m{i}"]) / facts[f"s{i}"] if facts[f"s{i}"] else F.lit(0.0) for i, c in enumerate(columns)]
    scaled = cut_lineage(data.withColumn("features", F.array(*parts)))
    own = [col(c) for c in columns]
    pool = scaled.orderBy(F.xxhash64(*own), *own).select("features").limit(POOL).collect()
    points = np.array([r["features"] for r in pool])
    cells = _cells(scaled, len(columns))
    fits = {k * starts + i: first_centres(points, k, seed + i)
            for k in range(2, min(MAX_SEGMENTS, n // 5) + 1) for i in range(starts)}
    moving = dict(fits)
    for _ in range(iterations):
        if not moving:
            break
        for f, s in _cluster_sums(cells, moving).items():
            filled = s[:, 0] > 0
            centres = fits[f].copy()
            centres[filled] = s[filled, 3:] / s[filled, :1]
            if ((centres - fits[f]) ** 2).sum() <= TOLERANCE:
                del moving[f]
            else:
                moving[f] = centres
            fits[f] = centres
    sums = _cluster_sums(cells, fits)
    best = {}
    for f, s in sums.items():
        if (s[:, 0] > 0).sum() > 1:
            best[f // starts] = min(best.get(f // starts, (np.inf, f)), (s[:, 1].sum(), f))
    if not best:
        return None
    chosen = {f: fits[f] for _, f in best.values()}
    scores = _silhouettes(scaled, chosen, sums)
    k = max(best, key=lambda k: (scores[best[k][1]], -k))
    cost, f = best[k]
    centres = fits[f][sums[f][:, 0] > 0]

    def distance(centre: np.ndarray) -> Column:
        return reduce(lambda a, b: a + b, [(F.col("features")[i] - float(v)) ** 2 for i, v in enumerate(centre)])

    nearest = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    assigned = scaled.withColumn("segment", nearest["i"]).drop("features")
    return Segments(columns, k, float(scores[f]), assigned, centres, float(cost))


def segment_profiles(segments: Segments) -> DataFrame:
    """Size, share and column means in original units, one row per segment."""
    sizes = segments.assigned.groupBy("segment").agg(
        F.count("*").alias("size"), *[F.avg(col(c)).alias(f"mean_{c}") for c in segments.columns])
    return (
        add_totals(sizes, all_rows=F.sum("size"))
        .withColumn("pct_of_data", F.col("size") / F.col("all_rows") * 100).drop("all_rows")
        .withColumn("k", F.lit(segments.k)).withColumn("silhouette", F.lit(segments.silhouette))
        .orderBy("segment")
    )


def segment_differences(segments: Segments) -> DataFrame:
    """Columns by the variance of their standardised centres: where the segments differ most."""
    rows = [(c, float(v)) for c, v in zip(segments.columns, segments.centres.var(axis=0, ddof=1))]
    return segments.assigned.sparkSession.createDataFrame(
        rows, "column string, variance double").orderBy(F.col("variance").desc(), "column")


def segment_contrast(segments: Segments) -> DataFrame:
    """Highest and lowest segment on the most differing column, and their ratio if both positive."""
    primary = segment_differences(segments).first()["column"]
    mean = col(f"mean_{primary}")
    best = F.max(F.struct(mean.alias("value"), "segment"))
    worst = F.min(F.struct(mean.alias("value"), "segment"))
    both = (F.col("best.value") > 0) & (F.col("worst.value") > 0)
    return (
        segment_profiles(segments).agg(best.alias("best"), worst.alias("worst"))
        .select(F.lit(primary).alias("column"), F.col("best.segment").alias("best_segment"),
                F.col("best.value").alias("best_mean"),
                F.col("worst.segment").alias("worst_segment"),
                F.col("worst.value").alias("worst_mean"),
                F.when(both, F.col("best.value") / F.col("worst.value")).alias("ratio"))
    )


# --- anomalies ------------------------------------------------------------------------------------------

def anomalies(df: DataFrame, columns: list[str], *keys: str, contamination: float = CONTAMINATION,
              trees: int = TREES, sample_size: int = SAMPLE, seed: int = SEED,
              limit: int = LIMIT) -> DataFrame | None:
    """Rows with ``anomaly_score`` (lower is stranger) and ``is_anomaly``: the lowest 5 %.

    An isolation forest: each tree is grown by its own task from 256 rows of a shared random pool
    of at most trees x 256 rows, so the forest has a fixed size and travels as a broadcast. Rows
    are scored in Arrow batches where they lie. Scores are written once, because the exact cut at
    the 5th percentile and every report read them again. None if fewer than 50 complete rows.
    """
    columns = covered_columns(df, columns)
    if not columns:
        return None
    spark = df.sparkSession
    data = _complete(df, columns, *keys)
    n = data.count()
    if n < MIN_ROWS_ANOMALY:
        return None
    size, pool_size = min(sample_size, n), trees * sample_size
    drawn = data.select(*[col(c) for c in columns])
    if n > pool_size:
        drawn = drawn.sample(fraction=min(1.0, 1.2 * pool_size / n), seed=seed)
    pool = np.array([tuple(r) for r in drawn.limit(2 * pool_size).collect()], dtype=float)
    shared_pool = spark.sparkContext.broadcast(pool)

    def grow(batches):
        for batch in batches:
            for tree_id in batch["id"]:
                rng = np.random.default_rng([seed, int(tree_id)])
                rows = shared_pool.value[rng.choice(len(shared_pool.value), size, replace=False)]
                tree = grow_tree(rows, rng)
                yield pd.DataFrame({"tree": int(tree_id), "node": np.arange(len(tree["left"])),
                                    **tree})

    nodes = spark.range(trees).repartition(min(trees, spark.sparkContext.defaultParallelism)) \
        .mapInPandas(grow, "tree long, node long, feature long, value double, left long, depth double") \
        .orderBy("tree", "node").toPandas()  # at most trees x 511 nodes
    forest = [{c: g[c].to_numpy() for c in ("feature", "value", "left", "depth")}
              for _, g in nodes.groupby("tree")]
    shared_forest = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        x = np.column_stack([f.to_numpy(dtype=float) for f in features])
        return pd.Series(scores(x, shared_forest.value, size))

    scored = cut_lineage(data.withColumn("anomaly_score", score(*[col(c) for c in columns])))
    cut = quantile_row(scored, {"cut": ("anomaly_score", contamination)}, limit).first()["cut"]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") < F.lit(cut))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n_rows"), F.count_if("is_anomaly").alias("n_anomalies"),
        (ratio(F.count_if("is_anomaly"), F.count("*")) * 100).alias("anomaly_pct"))


def top_anomalies(scored: DataFrame, *keys: str, n: int = 10) -> DataFrame:
    """The n strangest rows; equal scores in the order of the keys."""
    return scored.filter("is_anomaly").orderBy("anomaly_score", *keys).limit(n)


def standout_columns(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by the mean distance of anomalies from the normal rows, in normal deviations."""
    normal = ~F.col("is_anomaly")
    row = scored.agg(F.count_if(normal).alias("n"), *[
        F.struct(F.avg(F.when(normal, col(c))).alias("m"), F.stddev_samp(F.when(normal, col(c))).alias("s"),
                 F.avg(col(c)).alias("m_all"), F.stddev_samp(col(c)).alias("s_all")).alias(f"c{i}")
        for i, c in enumerate(columns)]).first()
    few = row["n"] <= 5
    distances = []
    for i, c in enumerate(columns):
        mean, std = (row[f"c{i}"]["m_all"], row[f"c{i}"]["s_all"]) if few else \
            (row[f"c{i}"]["m"], row[f"c{i}"]["s"])
        distances.append(F.avg(F.when(
            F.col("is_anomaly"), F.abs((col(c) - F.lit(mean)) / F.lit(std or 1.0)))).alias(f"d{i}"))
    one = scored.agg(*distances)
    return unpivot(one, [(F.lit(c), F.col(f"d{i}")) for i, c in enumerate(columns)],
                   ["column", "mean_abs_z"]).orderBy(F.col("mean_abs_z").desc_nulls_last(), "column")


# --- forecast ---------------------------------------------------------------------------------------------

def forecast(df: DataFrame, ts: str, metric: str, key: str | None = None,
             months: int = FORECAST_MONTHS, min_months: int = MIN_MONTHS) -> DataFrame:
    """(key, period, value, type): monthly history and Holt's linear forecast of every series.

    Spark adds up the months; a series of at least twelve months is then fitted by one task as a
    group of one row per month. Many keys are fitted side by side.
    """
    label: Column = col(key).cast("string") if key else F.lit("all")
    monthly = (
        df.filter(col(ts).isNotNull() & col(metric).isNotNull() & label.isNotNull())
        .groupBy(label.alias("key"), month_of(ts).alias("period"))
        .agg(F.sum(col(metric).cast("double")).alias("value"))
    )

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("period")
        if len(series) < min_months:
            return series.iloc[:0].assign(type="historical")
        last = pd.Period(series["period"].iloc[-1], "M")
        ahead = pd.DataFrame({
            "key": series["key"].iloc[0], "period": [str(last + i + 1) for i in range(months)],
            "value": holt_forecast(series["value"].to_numpy(), months), "type": "forecast"})
        return pd.concat([series.assign(type="historical"), ahead])[["key", "period", "value", "type"]]

    return monthly.groupBy("key").applyInPandas(
        fit, "key string, period string, value double, type string")


# --- gates --------------------------------------------------------------------------------------------------

def ml_gates(prof: DataFrame) -> DataFrame:
    """(model, status, reason): which models a table qualifies for, from its profile."""
    from assay.operators.profiling import MIN_ROWS, target_column
    usable = F.count_if((F.col("dtype") == "numeric") | F.col("is_binary"))
    one = prof.agg(F.max("n_rows").alias("n"), usable.alias("usable"),
                   F.count_if(F.col("dtype") == "datetime").alias("dates")) \
        .withColumn("target", target_column(prof).scalar())
    n, eligible = F.col("n"), (F.col("n") >= MIN_ROWS) & (F.col("usable") >= 2)
    reasons = {
        "feature_importance": F.when(~eligible, "too few rows or numeric columns")
        .when(F.col("target").isNull(), "no target column")
        .when(n < MIN_ROWS_REGRESSION, "needs 30 rows"),
        "segments": F.when(~eligible, "too few rows or numeric columns")
        .when(n < MIN_ROWS_SEGMENTS, "needs 30 rows"),
        "anomalies": F.when((F.col("usable") < 1) | (n < MIN_ROWS_ANOMALY),
                            "needs 50 rows and a numeric column"),
        "forecast": F.when(F.col("dates") == 0, "no date column")
        .when(F.col("usable") == 0, "no numeric column").when(n < MIN_MONTHS, "needs 12 rows"),
    }
    rows = unpivot(one, [(F.lit(m), r) for m, r in reasons.items()], ["model", "reason"])
    return rows.select("model", F.when(F.col("reason").isNull(), "run").otherwise("skipped")
                       .alias("status"), "reason")
