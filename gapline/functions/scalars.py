"""Column expressions, all of built-in functions but for the fold of a timeline.

Array lambdas are evaluated by Spark's interpreter, the rest in generated code; the fold
of a timeline takes Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Engine source tags.
SOURCE_REUSED = "lichess"
SOURCE_COMPUTED = "local_stockfish"
SOURCE_UNKNOWN = "unknown"
# Centipawn limits of a loss.
INACCURACY_CP, MISTAKE_CP, BLUNDER_CP = 50, 100, 300
WINNING_CP, THROWN_CP = 300, 100
# An integer above this is an epoch in milliseconds.
EPOCH_MS_FLOOR = 100_000_000_000
TOD_LABELS = ["morning", "midday", "evening", "night"]


def content_key(cols: list[Column]) -> Column:
    """md5 over the fields joined with a bar, a null field counting as empty text."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def winner_from_result(result: Column) -> Column:
    return F.when(result == "1-0", "white").when(result == "0-1", "black").otherwise("draw_or_other")


def zoned_timestamp(date: Column, time_text: Column) -> Column:
    """Date and time text, zone suffix honoured; bad text gives null."""
    return F.concat(date.cast("string"), F.lit(" "), time_text.cast("string")).try_cast("timestamp")


def local_timestamp(date: Column, time_text: Column) -> Column:
    """As above with everything from the first plus sign on cut off."""
    clock = F.split_part(time_text.cast("string"), F.lit("+"), F.lit(1))
    return F.concat(date.cast("string"), F.lit(" "), clock).try_cast("timestamp_ntz")


def _epoch_or_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.IntegralType):
        return F.when(c > EPOCH_MS_FLOOR, F.timestamp_millis(c.cast("bigint")))
    if isinstance(dtype, T.NumericType):
        number = c.try_cast("bigint")
        return F.when(number > EPOCH_MS_FLOOR, F.timestamp_millis(number))
    text = c.cast("string")
    number = text.try_cast("bigint")
    # Digits alone are never a date; a date has year, month and day.
    dated = F.when(text.rlike(r"^\s*\d+-\d+-\d+"), text.try_cast("timestamp"))
    return F.when(number > EPOCH_MS_FLOOR, F.timestamp_millis(number)).when(number.isNull(), dated)


def event_time(df: DataFrame, last_move: str, created: str, date: str) -> Column:
    """First usable of last move, creation and date.

    A whole number above the limit is epoch milliseconds, anything else is read as
    text. Columns that are numbers or times already skip the detour over text.
    """
    return F.coalesce(*[_epoch_or_text(F.col(c), df.schema[c].dataType) for c in (last_move, created, date)])


def side_outcome(winner: Column, side: str) -> Column:
    other = "black" if side == "white" else "white"
    return F.when(winner == side, "win").when(winner == other, "loss").otherwise("draw_or_other")


def player_side(white_name: Column, player: Column) -> Column:
    return F.when(F.lower(F.coalesce(white_name, F.lit(""))) == F.lower(player), "white").otherwise("black")


def player_result(winner: Column, side: Column) -> Column:
    return F.when(winner == side, 1.0).when(winner.isNull(), 0.5).otherwise(0.0)


def rating_change(white_diff: Column, black_diff: Column, side: Column) -> Column:
    picked = F.when(side == "white", white_diff.cast("string")).otherwise(black_diff.cast("string"))
    return F.coalesce(picked.try_cast("double"), F.lit(0.0))


def move_count(moves: Column) -> Column:
    """Whitespace-separated tokens, one at least."""
    tokens = F.filter(F.split(F.coalesce(moves, F.lit("")), r"\s+"), lambda t: t != "")
    return F.greatest(F.lit(1), F.size(tokens))


def text_length(text: Column) -> Column:
    return F.length(text).cast("long")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def last_or_created(last: Column, created: Column) -> Column:
    """A missing or zero last move falls back to the creation time."""
    return F.when(_or_zero(last) == 0, _or_zero(created)).otherwise(last)


def seconds_per_move(created: Column, last: Column, moves: Column) -> Column:
    span = (last_or_created(last, created) - _or_zero(created)) / 1000.0
    pairs = F.greatest(F.lit(1).cast("long"), F.floor(moves / 2))
    return F.greatest(F.lit(0.0), span) / pairs


ENGINE_FIELDS = [
    "my_acpl",
    "my_blunder_count",
    "my_mistake_count",
    "my_inaccuracy_count",
    "largest_eval_drop_cp",
    "avg_eval_drop_cp",
    "eval_volatility",
    "threw_winning_position",
]


def _timeline_fold():
    """Arrow function over whole batches: loss statistics of each array of evaluations."""
    limits = (BLUNDER_CP, MISTAKE_CP, INACCURACY_CP, WINNING_CP, THROWN_CP)

    def fold(evals: pa.Array, white: pa.Array) -> pa.Array:
        blunder, mistake, inaccuracy, winning, thrown = limits
        plies = evals.flatten()
        size = pc.fill_null(pc.list_value_length(evals), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        start = end - size
        known = pc.is_valid(plies).to_numpy(zero_copy_only=False)
        cp = pc.fill_null(plies, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = pc.if_else(pc.fill_null(white, False), 1, 0).to_numpy(zero_copy_only=False)
        ply = np.arange(len(cp)) - np.repeat(start, size)
        sign = np.repeat(2 * first - 1, size)
        own = (ply > 0) & (ply % 2 == np.repeat(first, size))
        before, here = np.roll(cp, 1) * sign, cp * sign
        loss = np.where(own & known & np.roll(known, 1), np.maximum(before - here, 0), 0)

        def total(x):
            upto = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            return upto[end] - upto[start]

        largest = np.zeros(len(size), np.int64)
        some = np.flatnonzero(size)
        if len(some):
            largest[some] = np.maximum.reduceat(loss, start[some])
        mean = total(loss) / np.maximum(total(own), 1)
        # Sums are whole numbers, so the deviation has no rounding until its root.
        whole = np.where(total(~known) > 0, 0, size * total(cp * cp) - total(cp) ** 2)
        lost_win = total((loss > 0) & (before >= winning) & (here < thrown)) > 0
        return pa.StructArray.from_arrays(
            [
                pa.array(mean),
                *(pa.array(total(loss >= limit), pa.int32()) for limit in (blunder, mistake, inaccuracy)),
                pa.array(largest, pa.float64()),
                pa.array(mean),
                pa.array(np.sqrt(whole / np.maximum(size * size, 1))),
                pa.array(lost_win, pa.int32()),
            ],
            ENGINE_FIELDS,
        )

    return fold


_FOLDED = "struct<my_acpl:double,my_blunder_count:int,my_mistake_count:int,my_inaccuracy_count:int,largest_eval_drop_cp:double,avg_eval_drop_cp:double,eval_volatility:double,threw_winning_position:int>"


def timeline_summary(evals: Column, side: Column, source: Column | None = None) -> Column:
    """Struct of loss statistics over an array of evaluations, one per ply.

    A player's own plies are every second one from the first after the start. One fold
    of a whole batch's plies, by Arrow: Spark's array functions are interpreted (four
    times slower here, a single aggregate over a struct twenty times), and an explode
    has to shuffle the rows and join them back. No timeline leaves its row. A null
    evaluation counts as no loss, and a timeline with one has volatility 0.
    """
    folded = F.arrow_udf(_timeline_fold(), _FOLDED)(evals, side == "white")
    fields = [folded[name].alias(name) for name in ENGINE_FIELDS]
    return F.when(evals.isNotNull(), F.struct(*fields, *([source.alias("engine_source")] if source is not None else [])))


# An analysis with none of these is an empty document, which counts as absent.
_ANALYSIS_FIELDS = ["acpl", "blunder", "blunders", "mistake", "mistakes", "inaccuracy", "inaccuracies"]


def _present(side: Column) -> Column:
    return side.isNotNull() & F.coalesce(*[side[f].cast("double") for f in _ANALYSIS_FIELDS]).isNotNull()


def engine_summary(analysis: Column, white: Column, black: Column, side: Column, evals: Column) -> Column:
    """Supplied per-side analysis if there is any, else the timeline, else null fields."""
    supplied = (F.coalesce(F.size(analysis), F.lit(0)) > 0) | _present(white) | _present(black)
    mine = F.when(side == "white", white).otherwise(black)

    def whole(*names: str) -> Column:
        return F.coalesce(*[mine[n] for n in names], F.lit(0)).cast("int")

    none_d, none_i = F.lit(None).cast("double"), F.lit(None).cast("int")
    reused = F.struct(
        F.coalesce(mine["acpl"], F.lit(0.0)).alias("my_acpl"),
        whole("blunder", "blunders").alias("my_blunder_count"),
        whole("mistake", "mistakes").alias("my_mistake_count"),
        whole("inaccuracy", "inaccuracies").alias("my_inaccuracy_count"),
        none_d.alias("largest_eval_drop_cp"),
        none_d.alias("avg_eval_drop_cp"),
        none_d.alias("eval_volatility"),
        none_i.alias("threw_winning_position"),
        F.lit(SOURCE_REUSED).alias("engine_source"),
    )
    needed = F.when(~supplied, evals)  # only these go to the fold
    computed = timeline_summary(needed, side, F.lit(SOURCE_COMPUTED))
    return F.when(supplied, reused).when(F.size(evals) > 0, computed)


def engine_defaults(engine: Column) -> dict[str, Column]:
    """Missing engine numbers become 0, a missing source becomes ``unknown``."""
    out = {f: F.coalesce(engine[f].cast("double"), F.lit(0.0)) for f in ENGINE_FIELDS[:-1]}
    out["threw_winning_position"] = F.coalesce(engine["threw_winning_position"], F.lit(0)).cast("int")
    out["engine_source"] = F.coalesce(engine["engine_source"], F.lit(SOURCE_UNKNOWN))
    return out


def local_hour(epoch_ms: Column, zone: str) -> Column:
    """Hour of day in ``zone``. The session zone must be UTC."""
    return F.hour(F.from_utc_timestamp(F.timestamp_millis(epoch_ms), zone))


def time_of_day(hour: Column) -> Column:
    return (
        F.when(hour.isNull(), "unknown")
        .when(hour.between(5, 8), "morning")
        .when(hour.between(9, 17), "midday")
        .when(hour.between(18, 22), "evening")
        .otherwise("night")
    )


def one_hot_time_of_day(label: Column) -> dict[str, Column]:
    return {f"tod_{name}": (label == name).cast("tinyint") for name in TOD_LABELS}


def width_bins(value: Column, start: int, width: int) -> dict[str, Column]:
    """Bin index and its integer bounds."""
    idx = F.floor((value - start) / width).cast("int")
    return {
        "elo_bin_idx": idx,
        "elo_bin_lo": (F.lit(start) + idx * width).cast("int"),
        "elo_bin_hi": (F.lit(start) + (idx + 1) * width).cast("int"),
    }


def selection_score() -> Column:
    """Diversity score of a profile row. The weights are fixed values."""
    c = F.col
    return (
        1.5 * F.log1p(c("n_games").cast("double"))
        + 2.0 * F.log1p(c("n_sessions").cast("double"))
        + 1.2 * F.log1p(F.greatest(c("coverage_days"), F.lit(0)).cast("double"))
        + 1.0 * c("active_months")
        + 0.8 * c("speed_diversity")
        + 0.7 * F.log1p(c("opening_diversity").cast("double"))
        + F.coalesce(c("opponent_elo_stddev"), F.lit(0.0)) / 150.0
        + F.coalesce(c("rating_stddev"), F.lit(0.0)) / 75.0
        + 0.35 * c("elo_drop_steps")
        + F.when(c("outcome_diversity") >= 3, 0.5).otherwise(0.0)
    )


def as_number(df: DataFrame, name: str) -> Column:
    """A column as double; text that cannot be read, and NaN, become null."""
    dtype, c = df.schema[name].dataType, F.col(name)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        value = c.cast("double")
    else:
        value = c.cast("string").try_cast("double")
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DecimalType)):
        return value
    return F.when(~F.isnan(value), value)


def number_or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_number(df, name), F.lit(0.0))
