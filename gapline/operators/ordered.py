"""Ordered per-group computations that stay balanced when one group is huge.

A plain ``Window.partitionBy(player)`` sends all rows of a player to one task.
Here every group above ``max_rows`` is cut into parts along its order.
Each part is scanned by its own window, one small summary row per part carries
the state of the earlier parts, and the two are combined. Groups below the bound
take the plain window, so data without hot groups keeps the one-shuffle plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.runtime import BROADCAST_ROWS, cut_lineage

MAX_GROUP_ROWS = 2_000_000
PART = "_part"
ALL = "_all"

_OVERSPLIT = 2
_TRIES = 4
# Sampled cuts are not exact; a part may have so many times the bound.
_SLACK = 2
# Rows a task and its file should have at least, however low the bound of a part is.
TASK_ROWS = 250_000
# A cut frame is used twice by every scan, as rows and for its carry. Fixing it
# after this many scans keeps the plan from doubling on and on.
_SCANS_PER_CUT = 2

Spec = tuple  # (kind, column name) or (kind,)


@dataclass(frozen=True)
class Ordered:
    """A frame with its group columns, its total order and, if needed, its parts."""

    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    parts: int = 0
    scans: int = 0

    # ------------------------------------------------------------ helpers
    def _keys(self, by) -> list[str]:
        return list(by or self.by)

    def _local(self, by, reverse: bool):
        keys = self._keys(by) + ([PART] if self.split else [])
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*keys).orderBy(*order)

    def with_df(self, df: DataFrame) -> "Ordered":
        return replace(self, df=df)

    def with_columns(self, cols: dict[str, Column]) -> "Ordered":
        return self.with_df(self.df.withColumns(cols))

    def finer(self, by) -> "Ordered":
        """The same rows and parts under finer groups, each contiguous in the order."""
        return replace(self, by=tuple(by))

    def result(self) -> DataFrame:
        return self.df.drop(PART, ALL)

    def _stepped(self, df: DataFrame) -> "Ordered":
        """Count a scan over parts; every second one is written to the shared folder."""
        if self.scans + 1 < _SCANS_PER_CUT:
            return replace(self, df=df, scans=self.scans + 1)
        return replace(self, df=cut_lineage(df), scans=0)

    # --------------------------------------------------------------- scan
    def scan(self, specs: dict[str, Spec], by=None) -> "Ordered":
        """Add running values. Kinds:

        ``count`` position from 1, ``sum``, ``max``, ``min`` from the first row to
        this one, ``max_before``, ``min_before`` up to the row before, ``first``
        value of the first row, ``lag`` value of the row before, ``total_max``,
        ``total_min``, ``total_sum``, ``total_count`` over the group. With ``rev_``
        in front, the walk starts at the last row.

        ``by`` may refine the group columns, as long as each finer group is
        contiguous in the order. All specs of a call share one carry.
        """
        if not self.split:
            return self.with_columns({out: self._direct(spec, by) for out, spec in specs.items()})

        keys = self._keys(by)
        near = {f"_l_{out}": self._direct(spec, by) for out, spec in specs.items()}
        for way in (False, True):
            if any(spec[0] == ("rev_lag" if way else "lag") for spec in specs.values()):
                near[f"_rn{int(way)}"] = F.row_number().over(self._local(by, way))
        carry = self._carry(keys, specs)
        joined = self._meet(self.df.withColumns(near), carry, keys)
        out = {name: self._combine(spec, f"_l_{name}", f"_c_{name}") for name, spec in specs.items()}
        drop = list(near) + [f"_c_{name}" for name in specs]
        return self._stepped(joined.withColumns(out).drop(*drop))

    def _direct(self, spec: Spec, by) -> Column:
        kind = spec[0].removeprefix("rev_")
        col = F.col(spec[1]) if len(spec) > 1 else None
        local = self._local(by, spec[0] != kind)
        running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = local.rowsBetween(Window.unboundedPreceding, -1)
        whole = local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if kind == "count":
            return F.row_number().over(local).cast("long")
        if kind == "sum":
            return F.sum(col).over(running)
        if kind == "max":
            return F.max(col).over(running)
        if kind == "min":
            return F.min(col).over(running)
        if kind == "max_before":
            return F.max(col).over(earlier)
        if kind == "min_before":
            return F.min(col).over(earlier)
        if kind == "first":
            return F.first(col).over(running)
        if kind == "lag":
            return F.lag(col).over(local)
        if kind == "total_max":
            return F.max(col).over(whole)
        if kind == "total_min":
            return F.min(col).over(whole)
        if kind == "total_sum":
            return F.sum(col).over(whole)
        if kind == "total_count":
            return F.count(F.lit(1)).over(whole)
        raise ValueError(f"unknown kind: {spec[0]}")

    def _carry(self, keys: list[str], specs: dict[str, Spec]) -> DataFrame:
        """State before each part (or the whole-group total), one row per part.

        Only cut groups have a part number, so the filter keeps this to hot groups.
        A finer group contributes a row only where it spans several parts, so the
        carry never has more than two rows per part.
        """
        position = F.struct(*[F.col(c) for c in self.order])
        aggs = []
        for out, spec in specs.items():
            kind = spec[0].removeprefix("rev_")
            head, tail = (F.max_by, F.min_by) if spec[0] != kind else (F.min_by, F.max_by)
            base = kind.removeprefix("total_").removesuffix("_before")
            col = F.col(spec[1]) if len(spec) > 1 else None
            if base == "count":
                agg = F.count(F.lit(1))
            elif base == "sum":
                agg = F.sum(col)
            elif base == "max":
                agg = F.max(col)
            elif base == "min":
                agg = F.min(col)
            elif base == "first":
                agg = head(F.struct(col.alias("v")), position)
            else:
                agg = tail(F.struct(col.alias("v")), position)
            aggs.append(agg.alias(f"_s_{out}"))
        summary = self.df.filter(F.col(PART).isNotNull()).groupBy(*keys, PART).agg(*aggs)

        forward = Window.partitionBy(*keys).orderBy(F.col(PART).asc())
        backward = Window.partitionBy(*keys).orderBy(F.col(PART).desc())
        whole = forward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        merged = {"_span": F.count(F.lit(1)).over(whole)}
        for out, spec in specs.items():
            part = F.col(f"_s_{out}")
            kind = spec[0].removeprefix("rev_")
            across = backward if spec[0] != kind else forward
            frame = whole if kind.startswith("total_") else across.rowsBetween(Window.unboundedPreceding, -1)
            base = kind.removeprefix("total_").removesuffix("_before")
            if base in ("count", "sum"):
                value = F.sum(part)
            elif base == "max":
                value = F.max(part)
            elif base == "min":
                value = F.min(part)
            elif base == "first":
                value = F.first(part)
            else:
                value = F.last(part)
            merged[f"_c_{out}"] = value.over(frame)
        carry = (
            summary.withColumns(merged)
            .filter(F.col("_span") > 1)
            .select(*keys, PART, *[f"_c_{out}" for out in specs])
        )
        return self._small(carry)

    @staticmethod
    def _meet(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with the carry of their part; a null key is a key."""
        names = {key: f"_key{i}" for i, key in enumerate([*keys, PART])}
        same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()])
        return df.join(carry.withColumnsRenamed(names), same, "left").drop(*names.values())

    def _small(self, carry: DataFrame) -> DataFrame:
        return F.broadcast(carry) if self.parts * 2 <= BROADCAST_ROWS else carry

    @staticmethod
    def _combine(spec: Spec, near: str, far: str) -> Column:
        kind = spec[0].removeprefix("rev_")
        a, b = F.col(near), F.col(far)
        if kind == "count":
            return a + F.coalesce(b, F.lit(0))
        if kind == "sum":
            return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(a + b)
        if kind in ("max", "max_before"):
            return F.greatest(a, b)
        if kind in ("min", "min_before"):
            return F.least(a, b)
        if kind == "first":
            return F.when(b.isNotNull(), b["v"]).otherwise(a)
        if kind == "lag":
            return F.when(F.col(f"_rn{int(spec[0] != kind)}") == 1, b["v"]).otherwise(a)
        return F.coalesce(b, a)

    # ------------------------------------------------------------- rolling
    def rolling_mean(self, outs: dict[str, str], size: int, by=None) -> "Ordered":
        """Mean over this row and up to ``size`` - 1 rows before it in the group."""
        local = self._local(by, reverse=False)
        frame = local.rowsBetween(-(size - 1), Window.currentRow)
        if not self.split:
            return self.with_columns({out: F.avg(F.col(src).cast("double")).over(frame) for out, src in outs.items()})

        keys = self._keys(by)
        values = F.struct(*[F.col(src).cast("double").alias(out) for out, src in outs.items()])
        # Each part exists with at least one row, so the last rows before a part
        # lie in the nearest ``size`` - 1 parts.
        ends = (
            self.df.filter(F.col(PART).isNotNull())
            .withColumn("_rev", F.row_number().over(self._local(by, reverse=True)))
            .filter(F.col("_rev") < size)
            .groupBy(*keys, PART)
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rev")).alias("p"), values.alias("v")))).alias("_end"))
        )
        before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(-(size - 1), -1)
        tail = F.flatten(F.collect_list("_end").over(before))
        carry = self._small(
            ends.withColumn("_tail", F.transform(tail, lambda e: e["v"]))
            .filter(F.size("_tail") > 0)
            .select(*keys, PART, "_tail")
        )
        joined = self._meet(self.df.withColumn("_near", F.collect_list(values).over(frame)), carry, keys)
        joined = joined.withColumn(
            "_last", F.when(F.col("_tail").isNull(), F.col("_near")).otherwise(F.concat("_tail", "_near"))
        ).withColumn(
            "_last",
            F.slice("_last", F.greatest(F.size("_last") - size + 1, F.lit(1)), F.lit(size)),
        )

        def mean(out: str) -> Column:
            seen = F.filter(F.transform("_last", lambda e: e[out]), lambda v: v.isNotNull())
            total = F.aggregate(seen, F.lit(0.0), lambda acc, v: acc + v)
            return F.try_divide(total, F.size(seen))

        return self._stepped(joined.withColumns({out: mean(out) for out in outs}).drop("_near", "_tail", "_last"))


def arranged(df, by, order, max_rows: int = MAX_GROUP_ROWS) -> Ordered:
    """``arrange`` for a frame; an ``Ordered`` keeps its parts and takes finer groups."""
    return df.finer(by) if isinstance(df, Ordered) else arrange(df, by, order, max_rows)


def arrange(df: DataFrame, by, order, max_rows: int = MAX_GROUP_ROWS, rows_known: int | None = None) -> Ordered:
    """Prepare ordered computations over groups ``by`` in the order ``order``.

    One count per group tells whether any group is above ``max_rows``. If none is, the
    frame stays as it is. Otherwise the rows of hot groups alone are range partitioned
    by group and order, so that the cuts are sampled quantiles of the whole order, of any
    type and spread, nulls and NaN included; a row's part is its partition, or a run of
    ranks in it where ``max_rows`` is below ``TASK_ROWS``. The other rows have no part. The order must be total: a part that stays too big because its
    rows cannot be told apart is an error.
    ``rows_known`` is a row count the caller already has; within the bound it saves
    the check.
    """
    by, order = tuple(by), tuple(order)
    if not by:
        df = df.withColumn(ALL, F.lit(1))
        by = (ALL,)
    if rows_known is not None and rows_known <= max_rows:
        return Ordered(df, by, order, False)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    n_groups, n_rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if n_groups == 0:
        return Ordered(df, by, order, False)

    keys = cut_lineage(counts.select(*[F.col(c).alias(f"_hot{i}") for i, c in enumerate(by)]))
    keys = F.broadcast(keys) if n_groups <= BROADCAST_ROWS else keys
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_hot{i}")) for i, c in enumerate(by)])
    hot, parts = _cut(df.join(keys, same, "left_semi"), by, order, max_rows, n_rows)
    cold = df.join(keys, same, "left_anti").withColumn(PART, F.lit(None).cast("long"))
    return Ordered(cold.unionByName(hot), by, order, True, parts + n_groups)


def _cut(hot: DataFrame, by, order, max_rows: int, n_rows: int) -> tuple[DataFrame, int]:
    """Rows with their part, written once, and the number of parts.

    A range partition is a task and a file, so it is sized by ``TASK_ROWS`` and not by a
    lower bound: their number follows from the rows alone. Under a lower bound the ranks
    inside a partition cut it on; rows that the order does not tell apart stay together.
    """
    per_task = max(max_rows, TASK_ROWS)
    tasks = -(-n_rows // per_task) * _OVERSPLIT
    for _ in range(_TRIES):
        cut = hot.repartitionByRange(tasks, *[F.col(c).asc() for c in (*by, *order)])
        cut = cut.withColumn(PART, F.spark_partition_id().cast("long"))
        if max_rows < per_task:
            place = F.rank().over(Window.partitionBy(PART).orderBy(*[F.col(c).asc() for c in (*by, *order)]))
            cut = cut.withColumn("_piece", F.floor((place - 1) / max_rows).cast("long"))
            cut = cut.withColumn(PART, F.shiftleft(PART, 32) + F.col("_piece")).drop("_piece")
        cut = cut_lineage(cut)
        sizes = cut.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_n"))
        if sizes.agg(F.max("_n")).first()[0] <= _SLACK * max_rows:
            return cut, tasks + (n_rows // max_rows if max_rows < per_task else 0)
        tasks *= 2
    raise ValueError(f"a group cannot be cut by {', '.join(order)}: the order is not total")
