"""Shard manifests: de-duplication, unique names, a pick under a byte budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.operators.ordered import MAX_GROUP_ROWS, arrange
from gapline.runtime import cut_lineage


def first_per_key(df: DataFrame, key: str, seq, keep_empty: bool = False) -> DataFrame:
    """First row of each key in the order ``seq`` (a list of columns).

    ``min_by`` merges before the shuffle, so a key with many copies sends one row
    per input task. Empty and null keys are dropped unless kept on request.
    """
    rows = df if keep_empty else df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    order = F.struct(*[F.col(c) for c in seq])
    whole = F.struct(*[F.col(c) for c in df.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, order).alias("_row")).select("_row.*")


def oldest_first(df: DataFrame, created: str, tie: str, limit: int | None = None) -> DataFrame:
    """Oldest rows first, a missing time counting as 0; a cap when one is given."""
    ordered = df.orderBy(F.coalesce(F.col(created), F.lit(0)), tie)
    return ordered if limit is None else ordered.limit(limit)


def name_counts(df: DataFrame, name: str) -> DataFrame:
    """How often each name occurs."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n_same_name"))


def unique_names(df: DataFrame, name: str, url: str) -> DataFrame:
    """Add ``local_filename``: repeated names get 8 hex digits of the URL's SHA-1.

    Only repeated names travel to the join.
    """
    repeated = name_counts(df, name).filter("n_same_name > 1").select(name, F.lit(True).alias("_repeated"))
    file, suffix = F.col(name), F.regexp_extract(F.col(name), r"^.+(\.[^.]+)$", 1)
    stem = F.substr(file, F.lit(1), F.length(file) - F.length(suffix))
    marked = F.concat(stem, F.lit("__"), F.substring(F.sha1(F.col(url)), 1, 8), suffix)
    local = F.when(F.col("_repeated"), marked).otherwise(file)
    return df.join(repeated, name, "left").withColumn("local_filename", local).drop("_repeated")


def assert_unique(df: DataFrame, name: str = "local_filename") -> DataFrame:
    clash = name_counts(df, name).filter("n_same_name > 1").orderBy(name).first()
    if clash:
        raise RuntimeError(f"the local name {clash[0]} stands for two files or more")
    return df


def pick_under_budget(
    df: DataFrame,
    by,
    seq: str,
    size: str,
    max_bytes: int,
    max_items: int | None = None,
    max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Greedy pick per group from the newest row back: take what fits, skip what does not.

    A round goes on while the room left has the same highest power of two. In that span
    every smaller file fits, so running sums of the small ones tell the room at each
    place; a file at or above the power fits at most once, and then the room is below it.
    The first such file, or the small one that takes the room below the power, ends the
    round, and all up to there are decided. So there are no more rounds than the budget
    has bits, whatever the sizes and their order. ``seq`` is unique in a group.
    """
    by = list(by)
    rest = df.withColumns(
        {"_left": F.lit(max_bytes).cast("long"), "_room": F.lit(max_items).cast("long"), "_back": -F.col(seq)}
    ).filter((F.col(size) <= F.col("_left")) & (F.col("_room").isNull() | (F.col("_room") > 0)))
    line = arrange(cut_lineage(rest), by, ["_back"], max_group)  # cut once; what is left keeps its parts
    left, own, room = F.col("_left"), F.col(size), F.col("_room")
    power = F.when(left > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(left)) - 1)).otherwise(F.lit(1))
    small = own < power
    full = room.isNotNull() & (F.col("_n") >= room)  # with the small ones so far
    fits = ~small & ~full & (own <= left - F.col("_total"))
    last = small & (full | ((left > 0) & (left - F.col("_total") < power)))
    within = F.col("_end").isNull() | (F.col("_back") <= F.col("_end"))
    taken: DataFrame | None = None
    while True:
        line = line.with_columns({"_small": F.when(small, own).otherwise(0), "_one": small.cast("int")})
        line = line.scan({"_total": ("sum", "_small"), "_n": ("sum", "_one")})
        line = line.with_columns({"_stop": F.when(fits | last, F.col("_back"))}).scan({"_end": ("total_min", "_stop")})
        marked = cut_lineage(line.df.withColumn("_take", within & (small | fits)))
        now = marked.filter("_take").select(*df.columns)
        taken = now if taken is None else taken.unionByName(now)
        used = marked.filter("_take").groupBy(*by).agg(F.sum(size).alias("_used"), F.count(F.lit(1)).alias("_got"))
        rest = (
            marked.filter(~within)
            .join(used, by, "left")
            .withColumns({"_left": left - F.coalesce("_used", F.lit(0)), "_room": room - F.coalesce("_got", F.lit(0))})
            .filter((own <= left) & (room.isNull() | (room > 0)))
            .drop("_used", "_got", "_small", "_one", "_total", "_n", "_stop", "_end", "_take")
        )
        rest = cut_lineage(rest)
        if rest.isEmpty():
            return taken.orderBy(*by, seq)
        line = line.with_df(rest)
