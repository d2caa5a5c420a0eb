"""Report tables: descriptions, correlations, histograms, traces, run comparison."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.functions import scalars as S
from gapline.operators.ordered import MAX_GROUP_ROWS, arrange
from gapline.runtime import broadcast_if_small, cut_lineage
from gapline.schemas import LEAKY_COLUMNS, REPORT_PREFERRED

QUARTILES = (0.25, 0.5, 0.75)
# Bins of a histogram, most distinct values of a target that splits it.
HISTOGRAM_BINS = 30
CLASS_LIMIT = 8
# Size of a quantile sketch and half width of a bracket in ranks, a few of its errors.
SKETCH_K, BRACKET = 2048, 0.005
ROUNDING = 1e-14


# ------------------------------------------------------------ column choice
def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in skip and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def choose_features(df: DataFrame, drop: Iterable[str], target: str, numeric_only: bool = True) -> list[str]:
    """Model features by type; label-giving columns are out even when not listed."""
    skip = {*drop, target, *LEAKY_COLUMNS}
    cols = numeric_columns(df, skip) if numeric_only else [c for c in df.columns if c not in skip]
    if not cols:
        raise ValueError("every column is excluded, so there is no feature")
    return cols


def choose_report_features(df: DataFrame, max_features: int = 12, exclude: Iterable[str] = ()) -> list[str]:
    """Preferred columns first, padded with other numeric ones."""
    have = numeric_columns(df, [*LEAKY_COLUMNS, *exclude])
    first = [c for c in REPORT_PREFERRED if c in have]
    return (first + [c for c in have if c not in first])[:max_features]


def _numbers(df: DataFrame, cols: list[str], keep: Iterable[Column] = ()) -> DataFrame:
    """The columns as doubles ``_0``, ``_1`` ..., null and NaN as null, written once for several narrow scans."""
    return cut_lineage(df.select(*keep, *[S.as_number(df, c).alias(f"_{i}") for i, c in enumerate(cols)]))


# ---------------------------------------------------------------- describe
def describe(df: DataFrame, cols: list[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Count, mean, sample deviation, extremes, exact quartiles and missing share per column.

    One scan takes the moments and a mergeable quantile sketch of each column. The sketch
    brackets each quartile; a second scan counts what is below and inside each bracket,
    which proves that the quartile is inside (else the bracket is the whole range), and
    only the few values inside are shuffled and ranked. No row is multiplied.
    """
    spark, fixed = df.sparkSession, _numbers(df, cols)
    ranks = [min(1.0, max(0.0, q + side * BRACKET)) for q in QUARTILES for side in (-1, 1)]
    parts = []
    for i in range(len(cols)):
        v = F.col(f"_{i}")
        sketch = F.kll_sketch_agg_double(v, SKETCH_K)
        at = F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(r)) for r in ranks])
        parts.append(
            F.struct(
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.avg(v.isNull().cast("double")).alias("missing_frac"),
                F.when(F.count(v) > 0, at).alias("at"),
            ).alias(f"_{i}")
        )
    stats = fixed.agg(*parts).first()  # a struct per column
    brackets = []
    for i, one in enumerate(stats):
        for j, q in enumerate(QUARTILES if one["count"] else ()):
            low, high = one["at"][2 * j : 2 * j + 2]
            first = math.floor((one["count"] - 1) * q)
            brackets.append({"key": 3 * i + j, "col": F.col(f"_{i}"), "low": low, "high": high, "first": first, "second": min(first + 1, one["count"] - 1)})
    picked = _pick_ranks(fixed, brackets, stats, max_rows) if brackets else {}
    out = []
    for i, (name, one) in enumerate(zip(cols, stats)):
        quarters = []
        for j, q in enumerate(QUARTILES):
            lower, upper = picked.get(3 * i + j, (None, None))
            exact = (one["count"] - 1) * q
            quarters.append(None if lower is None else lower + (upper - lower) * (exact - math.floor(exact)))
        out.append((name, one["count"], one["mean"], one["std"], one["min"], *quarters, one["max"], one["missing_frac"]))
    return spark.createDataFrame(out, "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double, missing_frac double")


def _pick_ranks(fixed: DataFrame, brackets: list[dict], stats, max_rows: int) -> dict:
    """Values at the two ranks of each bracket, by its key."""
    inside = lambda b: (b["col"] >= b["low"]) & (b["col"] <= b["high"])
    counts = fixed.agg(*[F.count_if(b["col"] < b["low"]) for b in brackets], *[F.count_if(inside(b)) for b in brackets]).first()
    for n, b in enumerate(brackets):
        b["below"] = counts[n]
        if not b["below"] <= b["first"] or not b["second"] < b["below"] + counts[len(brackets) + n]:
            whole = stats[b["key"] // len(QUARTILES)]
            b["low"], b["high"], b["below"] = whole["min"], whole["max"], 0
    found = F.array_compact(F.array(*[F.when(inside(b), F.struct(F.lit(b["key"]).alias("key"), b["col"].alias("value"))) for b in brackets]))
    near = fixed.select(F.explode(found).alias("p")).groupBy("p.key", "p.value").agg(F.count(F.lit(1)).alias("_k"))
    line = arrange(near, ["key"], ["value"], max_rows).scan({"_upto": ("sum", "_k")})
    wanted = fixed.sparkSession.createDataFrame([(b["key"], b["first"] - b["below"], b["second"] - b["below"]) for b in brackets], "key int, _first long, _second long")
    placed = line.df.join(F.broadcast(wanted), "key")  # three rows a column

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_k") <= F.col(rank)), F.col("value")))

    return {r[0]: (r[1], r[2]) for r in placed.groupBy("key").agg(at("_first"), at("_second")).collect()}


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair over rows with both values; undefined gives 0.

    Every task sums products of its rows about the columns' means, as matrix products with
    the masks of known values, and sends one row per pair. No row is multiplied. Infinite
    values count as missing. Long form ``(x, y, corr)``.
    """
    spark, fixed = df.sparkSession, _numbers(df, cols)
    names = [f"_{i}" for i in range(len(cols))]
    finite = [F.when(F.abs(F.col(c)) < math.inf, F.col(c)).alias(c) for c in names]
    means = fixed.select(*finite).agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names]).first()
    sums = fixed.select(*finite).mapInArrow(_comoments([float(m) for m in means]), "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = lambda square, one: square - F.try_divide(one * one, F.col("n"))
    sx, sy = spread(F.col("xx"), F.col("x")), spread(F.col("yy"), F.col("y"))
    # A constant column has a spread of rounding errors only.
    varies = (sx > ROUNDING * F.col("xx")) & (sy > ROUNDING * F.col("yy"))
    corr = F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n")), F.sqrt(sx) * F.sqrt(sy))
    corr = F.when(varies, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), corr))).otherwise(0.0)
    both = total.select("i", "j", F.coalesce(corr, F.lit(0.0)).alias("corr"))
    listed = [(i, j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    pairs = F.broadcast(spark.createDataFrame(listed, "i int, j int, x string, y string"))  # a row per pair of columns
    ways = F.array_distinct(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    # Without rows there are no sums, and every pair gets its 0.
    return both.join(pairs, ["i", "j"], "right").select(F.explode(ways).alias("w"), F.coalesce("corr", F.lit(0.0)).alias("corr")).select("w.x", "w.y", "corr")


def _comoments(means: list[float]):
    """Task of the correlations: per pair of columns the sums over rows with both values."""

    def run(stream):
        size = len(means)
        n, x, xx, xy = (np.zeros((size, size)) for _ in range(4))
        for batch in stream:
            if not batch.num_rows:
                continue
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            off = np.stack([pc.fill_null(c, m).to_numpy(zero_copy_only=False) - m for c, m in zip(batch.columns, means)], axis=1)
            n += known.T @ known
            x += off.T @ known  # of the row's column, where the other is known
            xx += (off * off).T @ known
            xy += off.T @ off
        i, j = np.triu_indices(size)
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(v) for v in (n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j]))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    return run


# --------------------------------------------------------------- histograms
def histograms(df: DataFrame, cols: list[str], target: str | None = None, bins: int = HISTOGRAM_BINS, class_limit: int = CLASS_LIMIT) -> DataFrame:
    """Counts in equal bins over each column's range, the last bin closed.

    With a target of at most ``class_limit`` distinct values there is one histogram per
    value, each with its own range; with more the target is left out. A constant column
    gets a range of one around its value. Infinite values are left out. One scan finds the
    ranges, one counts: every task keeps a counter per class, column and bin, and no row
    is multiplied.
    """
    spark = df.sparkSession
    split = target is not None and df.select(target).dropna().distinct().limit(class_limit + 1).count() <= class_limit
    label = F.col(target).cast("string") if split else F.lit("all")
    fixed = _numbers(df, cols, [label.alias("class")]).where("class IS NOT NULL")
    names = [f"_{i}" for i in range(len(cols))]
    finite = fixed.select("class", *[F.when(F.abs(F.col(c)) < math.inf, F.col(c)).alias(c) for c in names])
    found = finite.groupBy("class").agg(*[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).collect()  # a row per class
    ranges = {}
    for row in found:
        for i, c in enumerate(names):
            low, high = row[f"min{c}"], row[f"max{c}"]
            if low is not None:
                ranges[row["class"], i] = (low - 0.5, high + 0.5) if low == high else (low, high)
    counted = finite.mapInArrow(_bin_counts(ranges, bins), "class string, i int, bin int, n long").groupBy("class", "i", "bin").agg(F.sum("n").alias("n"))
    listed = [(k, i, cols[i], float(low), float(high)) for (k, i), (low, high) in ranges.items()]
    known = F.broadcast(spark.createDataFrame(listed, "class string, i int, column string, lo double, hi double"))  # a row per class and column
    return counted.join(known, ["class", "i"]).select(
        "class", "column", "lo", "hi", "bin", "n", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_from")
    )


def _bin_counts(ranges: dict, bins: int):
    """Task of the histograms: a row per class, column and filled bin."""

    def run(stream):
        counts = {key: np.zeros(bins, np.int64) for key in ranges}
        for batch in stream:
            classes = batch.column(0)
            for key in pc.unique(classes).to_pylist():
                mine = batch.filter(pc.equal(classes, key))
                for i in range(batch.num_columns - 1):
                    if (key, i) in ranges:
                        low, high = ranges[key, i]
                        value = mine.column(i + 1).drop_null().to_numpy(zero_copy_only=False)
                        slot = np.minimum(np.floor((value - low) / ((high - low) / bins)).astype(np.int64), bins - 1)
                        counts[key, i] += np.bincount(slot, minlength=bins)
        rows = [(key, i, bin, n) for (key, i), many in counts.items() for bin, n in enumerate(many.tolist()) if n]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["class", "i", "bin", "n"])

    return run


# ------------------------------------------------------------------- traces
def largest_sessions(df: DataFrame, group, n: int) -> DataFrame:
    """The ``n`` groups with the most rows, smaller key first among equals."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), *group).limit(n)


def session_traces(df: DataFrame, group, order, pl: str, n: int = 16, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Position and value along the largest sessions."""
    top = broadcast_if_small(largest_sessions(df, group, n).select(*group))
    rows = df.join(top, list(group), "left_semi")
    line = arrange(rows, group, order, max_rows).scan({"game_in_session": ("count",)})
    return line.df.select(*group, "game_in_session", F.col(pl).cast("double").alias("value"))


def policy_traces(
    df: DataFrame, group, order, pl: str, action: str, score: str, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per row position, value, score, whether it is the peak, and the first stop of its session."""
    work = df.withColumns({"_pl": F.col(pl).cast("double"), "is_stop": (F.col(action) == "stop").cast("int")})
    line = arrange(work, group, order, max_rows).scan({"game_in_session": ("count",)})
    here = F.col("game_in_session")
    line = line.with_columns(
        {
            "_entry": F.when(F.col("_pl").isNotNull(), F.struct((-F.col("_pl")).alias("neg"), here.alias("pos"))),
            "_stop": F.when(F.col("is_stop") == 1, here),
        }
    )
    line = line.scan({"_top": ("total_min", "_entry"), "first_stop_game": ("total_min", "_stop")})
    return line.df.select(
        *group,
        "game_in_session",
        F.col("_pl").alias("value"),
        F.col(score).alias("score"),
        "is_stop",
        F.coalesce((here == F.col("_top.pos")).cast("int"), F.lit(0)).alias("is_peak"),
        "first_stop_game",
    )


# --------------------------------------------------------------------- runs
def compare_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Scalar numeric metrics of one-row frames side by side, missing ones null."""
    wide: DataFrame | None = None
    for name, row in runs.items():
        cols = [F.col(c).cast("double").alias(c) for c in numeric_columns(row)]
        one = row.select(F.lit(name).alias("run"), *cols)
        wide = one if wide is None else wide.unionByName(one, allowMissingColumns=True)
    return wide


def flatten_metrics(row: DataFrame, keys: Iterable[str] = (), prefix: str = "") -> DataFrame:
    """Numeric columns as (name, value) rows."""
    cols = [
        f.name
        for f in row.schema.fields
        if f.name not in set(keys) and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    pairs = F.array(
        *[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    return row.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")


def feature_sample(df: DataFrame, features: list[str], order, n: int = 32) -> DataFrame:
    """The first ``n`` rows of the model inputs as floats in contract order."""
    return df.orderBy(*order).limit(n).select(*[F.col(c).cast("float").alias(c) for c in features])
