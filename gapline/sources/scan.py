"""Reading game data: parquet folders, JSON documents, NDJSON."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyarrow import fs as arrow_fs

from gapline.schemas import GAME

SOURCE_FILE = "filename"

_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
# Digits that a whole number of each type may have.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def list_parquet(spark: SparkSession, dirs: Iterable[str] = (), globs: Iterable[str] = ()) -> list[str]:
    """Distinct parquet files under folders (recursive) and patterns, sorted by path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: set[str] = set()
    for folder in dirs:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(f"no such folder: {folder}")
        walk = fs.listFiles(path, True)
        while walk.hasNext():
            found.add(walk.next().getPath().toString())
    for pattern in globs:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            if status.isFile():
                found.add(status.getPath().toString())
    files = sorted(f for f in found if f.endswith(".parquet"))
    if not files:
        raise RuntimeError("the folders and patterns hold no parquet file")
    return files


def _widest(types: list[T.DataType]) -> T.DataType:
    """A type that holds the values of all; text where there is none.

    Structs unite their fields by name, arrays and maps their parts.
    """
    kinds = {type(t) for t in types}
    if all(t == types[0] for t in types):
        return types[0]
    if kinds == {T.StructType}:
        fields: dict[str, list[T.DataType]] = {}
        for field in (f for t in types for f in t.fields):
            fields.setdefault(field.name, []).append(field.dataType)
        return T.StructType([T.StructField(name, _widest(found)) for name, found in fields.items()])
    if kinds == {T.ArrayType}:
        return T.ArrayType(_widest([t.elementType for t in types]))
    if kinds == {T.MapType}:
        return T.MapType(_widest([t.keyType for t in types]), _widest([t.valueType for t in types]))
    if kinds <= set(_WHOLE):
        return max(types, key=lambda t: _WHOLE.index(type(t)))
    if kinds <= {*_WHOLE, T.DecimalType}:
        places = max(t.scale for t in types if isinstance(t, T.DecimalType))
        digits = max(t.precision - t.scale if isinstance(t, T.DecimalType) else _DIGITS[type(t)] for t in types)
        return T.DecimalType(digits + places, places) if digits + places <= 38 else T.DoubleType()
    if kinds <= {*_WHOLE, T.DecimalType, T.FloatType, T.DoubleType}:
        narrow = kinds <= {T.ByteType, T.ShortType, T.FloatType}
        return T.FloatType() if narrow else T.DoubleType()
    if kinds <= {T.DateType, T.TimestampType} or kinds <= {T.DateType, T.TimestampNTZType}:
        return next(t for t in types if not isinstance(t, T.DateType))
    return T.StringType()


def _conform(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """The value in the wider type; fields that a struct lacks are null."""
    if have == want:
        return value
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        mine = {f.name: f.dataType for f in have.fields}
        fields = [
            (_conform(value.getField(f.name), mine[f.name], f.dataType) if f.name in mine else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: _conform(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        entry = lambda e: F.struct(
            _conform(e["key"], have.keyType, want.keyType).alias("key"), _conform(e["value"], have.valueType, want.valueType).alias("value")
        )
        return F.map_from_entries(F.transform(F.map_entries(value), entry))
    return value.cast(want)


def _footer_keys(batches):
    """Task: a hash of each file's schema; null where pyarrow has no way to the file."""
    for batch in batches:
        keys = []
        for path in batch.column(0).to_pylist():
            try:
                store, inner = arrow_fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    footer = pq.ParquetFile(source)
                    own = (footer.metadata.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"")
                    keys.append(hashlib.md5(str(footer.schema).split("\n", 1)[1].encode() + own).hexdigest())
            except (OSError, pa.ArrowException):
                keys.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], ["path", "key"])


def _by_schema(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """Files of one schema together, from one job over the footers; unread ones stand alone."""
    tasks = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks)
    found: dict[str, list[str]] = {}
    for row in paths.mapInArrow(_footer_keys, "path string, key string").orderBy("path").collect():
        found.setdefault(row["key"] or row["path"], []).append(row["path"])
    return list(found.values())


def _merged(spark: SparkSession, files: list[str]) -> list[tuple[list[str], T.StructType]]:
    """Runs of files whose schemas merge: one job where all do, else one file of each schema decides."""
    try:
        return [(files, spark.read.option("mergeSchema", True).parquet(*files).schema)]
    except (PySparkException, Py4JJavaError):
        alike = {same[0]: same for same in _by_schema(spark, files)}
    return [([f for first in run for f in alike[first]], schema) for run, schema in _mergeable(spark, list(alike))]


def _mergeable(spark: SparkSession, files: list[str]) -> list[tuple[list[str], T.StructType]]:
    """Runs of files whose schemas merge, found by halving where a merge fails.

    The files differ in schema, so the jobs grow with the schemas, not with the files.
    """
    try:
        return [(files, spark.read.option("mergeSchema", True).parquet(*files).schema)]
    except (PySparkException, Py4JJavaError):
        if len(files) == 1:
            raise
    half = len(files) // 2
    return _mergeable(spark, files[:half]) + _mergeable(spark, files[half:])


def scan_parquet(spark: SparkSession, dirs: Iterable[str] = (), globs: Iterable[str] = ()) -> DataFrame:
    """All files as one frame, columns united by name, source path in ``filename``.

    Files whose schemas merge share one scan. Where a column's type differs, the
    narrower one is cast, which a merged-schema read refuses to do; structs, arrays and
    maps are united part by part.
    """
    groups: dict[str, tuple[list[str], T.StructType]] = {}
    for files, schema in _merged(spark, list_parquet(spark, dirs, globs)):
        groups.setdefault(schema.json(), ([], schema))[0].extend(files)
    seen: dict[str, list[T.DataType]] = {}
    for _, schema in groups.values():
        for field in schema.fields:
            seen.setdefault(field.name, []).append(field.dataType)
    target = {name: _widest(types) for name, types in seen.items()}
    frames = []
    for files, schema in groups.values():
        cols = [_conform(F.col(f"`{f.name}`"), f.dataType, target[f.name]).alias(f.name) for f in schema.fields]
        rows = spark.read.schema(schema).parquet(*files)
        frames.append(rows.select(*cols, F.col("_metadata.file_path").alias(SOURCE_FILE)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = GAME) -> DataFrame:
    """A file holding an array of documents, one row each. Bad JSON is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType = GAME) -> DataFrame:
    """One document per line; blank lines are skipped, anything not JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
