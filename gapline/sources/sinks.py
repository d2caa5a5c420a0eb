"""Writing tables and run manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by=()) -> str:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_ndjson(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def selection_manifest(eligible: DataFrame, per_bin: int, filters: Mapping, outputs: Mapping, source: str) -> DataFrame:
    """One row: filters, counts, the list of bins and the output paths.

    Bins are few by construction: the rating range over the bin width.
    """
    from gapline.operators.players import selection_counts

    counts = selection_counts(eligible, per_bin)
    total = F.col("elo_bin_lo").isNull()
    one_bin = F.struct("elo_bin_lo", "elo_bin_hi", "n_selected")
    zero = F.lit(0).cast("long")
    row = counts.agg(
        F.coalesce(F.max(F.when(total, F.col("n_eligible"))), zero).alias("n_eligible_players"),
        F.coalesce(F.max(F.when(total, F.col("n_selected"))), zero).alias("n_selected_players"),
        F.sort_array(F.collect_list(F.when(~total, one_bin))).alias("selected_bins"),
    )
    return row.select(
        F.lit(source).alias("source_table"),
        F.from_json(F.lit(json.dumps(dict(filters))), _flat_schema(filters)).alias("filters"),
        "*",
        F.from_json(F.lit(json.dumps(dict(outputs))), _flat_schema(outputs)).alias("outputs"),
    )


def _flat_schema(values: Mapping) -> str:
    names = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return ", ".join(f"`{k}` {names[type(v)]}" for k, v in values.items()) or "`none` string"


def run_manifest(spark: SparkSession, payload: Mapping) -> DataFrame:
    """A run's configuration and scalar results as a one-row frame (driver-side values)."""
    text = json.dumps(dict(payload), sort_keys=True)
    return spark.range(1).select(F.lit(text).alias("manifest"))


def write_manifest(row: DataFrame, path: str) -> str:
    row.coalesce(1).write.mode("overwrite").json(path)
    return path
