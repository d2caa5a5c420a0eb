"""Session settings, scratch storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows a side may have before it is broadcast. Every caller counts first.
BROADCAST_ROWS = 200_000


def build_session(master: str = "local[*]", app: str = "gapline", **conf: str) -> SparkSession:
    """Session for tests and the bench. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: epoch arithmetic on zone-less timestamps relies on it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, bench) gets a folder of its own;
    on a cluster it would be on one machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="gapline-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/gapline/{name}-{uuid.uuid4().hex[:12]}"


def _storable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _storable(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _storable(dtype.keyType) and _storable(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return all(_storable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.NullType, T.UserDefinedType, T.CalendarIntervalType))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from there.

    A lost executor then costs a re-read, not a recompute. Written as a table, so
    later steps read only the columns they use; types a table cannot hold take a
    reliable checkpoint.
    """
    spark = df.sparkSession
    if not all(_storable(f.dataType) for f in df.schema.fields):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoint"))
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after the side was written once and counted.

    Above the bound the side comes back unhinted and the join shuffles, with
    adaptive skew handling for hot keys. Writing it keeps the count from running
    the side's whole plan a second time.
    """
    fixed = cut_lineage(df)
    return F.broadcast(fixed) if fixed.count() <= max_rows else fixed
