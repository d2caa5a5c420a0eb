"""The split scan must equal the plain window for every kind, in both directions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapline.operators.ordered import arrange

SPECS = {
    "n": ("count",),
    "s": ("sum", "v"),
    "hi": ("max", "v"),
    "lo": ("min", "v"),
    "f": ("first", "v"),
    "p": ("lag", "v"),
    "th": ("total_max", "v"),
    "tl": ("total_min", "v"),
    "ts": ("total_sum", "v"),
    "tc": ("total_count",),
    "hb": ("max_before", "v"),
    "lb": ("min_before", "v"),
}
REVERSED = {name: (kind if kind.startswith("total_") else f"rev_{kind}", *col) for name, (kind, *col) in SPECS.items()}


def make(spark, kind):
    base = spark.range(600).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 17).cast("string"))).alias("k"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 101).cast("double")).alias("v"),
    )
    if kind == "ties":
        return base.withColumn("t", (F.col("id") > 300).cast("long"))
    if kind == "burst":
        return base.withColumn("t", F.when(F.col("id") < 500, F.col("id")).otherwise(F.col("id") * 1_000_000))
    if kind == "nulls":
        return base.withColumn("t", F.when(F.col("id") % 5 != 0, F.col("id") % 40))
    return base.withColumn("t", F.timestamp_millis(F.col("id") * 1000))


def rows(ordered):
    pdf = ordered.result().toPandas().sort_values("id").reset_index(drop=True)
    return pdf[sorted(pdf.columns)]


@pytest.mark.parametrize("kind", ["even", "ties", "burst", "nulls"])
@pytest.mark.parametrize("specs", [SPECS, REVERSED], ids=["forward", "reverse"])
def test_split_equals_plain(spark, kind, specs):
    df = make(spark, kind)
    plain = arrange(df, ["k"], ["t", "id"])
    split = arrange(df, ["k"], ["t", "id"], max_rows=20)
    assert not plain.split and split.split
    pd.testing.assert_frame_equal(
        rows(plain.scan(specs)), rows(split.scan(specs)), check_dtype=False
    )


def test_finer_groups_and_rolling(spark):
    df = make(spark, "even")
    flag = F.when(F.col("id") % 97 == 0, 1).otherwise(0)
    out = []
    for cap in (10_000, 15):
        o = arrange(df.withColumn("flag", flag), ["k"], ["t", "id"], max_rows=cap)
        o = o.scan({"g": ("sum", "flag")}).scan(SPECS, by=["k", "g"]).rolling_mean({"m": "v"}, 5, by=["k", "g"])
        out.append(rows(o))
    pd.testing.assert_frame_equal(out[0], out[1], check_dtype=False)


def test_parts_are_bounded(spark):
    df = make(spark, "burst")
    o = arrange(df, ["k"], ["t", "id"], max_rows=20)
    biggest = o.df.groupBy("k", "_part").count().agg(F.max("count")).first()[0]
    assert biggest <= 40


def spread(spark, kind, n=6000):
    base = spark.range(n).select("id", F.when(F.col("id") % 4 > 0, "hot").alias("k"), (F.col("id") % 13).alias("v"))
    order = {
        "geometric": F.pow(F.lit(1.01), "id"),
        "text": F.concat(F.lit("same beginning "), F.col("id").cast("string")),
        "infinite": F.when(F.col("id") == 7, float("inf")).when(F.col("id") == 8, float("-inf")).otherwise(F.col("id") / 1e6),
        "nan": F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id").cast("double")),
    }
    return base.withColumn("t", order[kind])


@pytest.mark.parametrize("kind", ["geometric", "text", "infinite", "nan"])
def test_any_order_is_cut_evenly(spark, kind):
    """Also groups whose key is null."""
    df = spread(spark, kind)
    split = arrange(df, ["k"], ["t", "id"], max_rows=100)
    sizes = split.df.groupBy("k", "_part").count().agg(F.max("count")).first()[0]
    assert split.split and sizes <= 200
    plain = arrange(df, ["k"], ["t", "id"]).scan({"s": ("sum", "v"), "p": ("lag", "id")})
    pd.testing.assert_frame_equal(rows(plain), rows(split.scan({"s": ("sum", "v"), "p": ("lag", "id")})), check_dtype=False)


def test_order_that_is_not_total_is_an_error(spark):
    with pytest.raises(ValueError, match="not total"):
        arrange(spark.range(500).select(F.lit(1).alias("k"), F.lit(2).alias("t")), ["k"], ["t"], max_rows=20)


def test_a_low_bound_makes_no_more_tasks(spark):
    """Parts follow the bound, tasks and files the rows."""
    split = arrange(spread(spark, "text"), ["k"], ["t", "id"], max_rows=5)
    sizes = split.df.filter("_part IS NOT NULL").groupBy("_part").count().agg(F.max("count"), F.count("count")).first()
    assert sizes[0] == 5 and sizes[1] >= 900
    assert len(split.df.inputFiles()) <= 4 and split.df.rdd.getNumPartitions() <= 32
    plain = arrange(spread(spark, "text"), ["k"], ["t", "id"]).scan({"s": ("sum", "v"), "p": ("lag", "id")})
    pd.testing.assert_frame_equal(rows(plain), rows(split.scan({"s": ("sum", "v"), "p": ("lag", "id")})), check_dtype=False)
