"""Sources and sinks: everything Spark reads and writes, as TidyFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..frame import TidyFrame


def session(name: str = "verbena", **conf) -> SparkSession:
    """A session with UTC time and adaptive execution; other settings as given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def from_rows(spark: SparkSession, rows: list, schema, **kwargs) -> TidyFrame:
    """A frame of Python rows; their order is the row order unless order_by says otherwise."""
    if "order_by" in kwargs:
        return TidyFrame(spark.createDataFrame(rows, schema), **kwargs)
    df = spark.createDataFrame(rows, schema)
    names = df.columns
    numbered = spark.createDataFrame([(*tuple(r), i) for i, r in enumerate(rows)], T.StructType([*df.schema.fields, T.StructField("__verbena_row", T.LongType())]))
    return TidyFrame(numbered.select(*numbered.columns), order=(("__verbena_row", False),)) if names else TidyFrame(df)


def from_pandas(spark: SparkSession, frame, **kwargs) -> TidyFrame:
    return TidyFrame(spark.createDataFrame(frame.assign(__verbena_row=range(len(frame)))), order=(("__verbena_row", False),), **kwargs)


def read(spark: SparkSession, path: str, format: str | None = None, schema=None, options: dict | None = None, **kwargs) -> TidyFrame:
    """Read parquet, csv, json, orc or text; the format is taken from the path's ending where it isn't given."""
    format = format or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet"
    reader = spark.read.format({"jsonl": "json", "ndjson": "json", "txt": "text"}.get(format, format)).options(**(options or {}))
    return TidyFrame((reader.schema(schema) if schema else reader).load(path), **kwargs)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> TidyFrame:
    return TidyFrame(spark.read.jdbc(url, table, properties={k: str(v) for k, v in options.items()}))


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> TidyFrame:
    return TidyFrame(spark.readStream.format(format).schema(schema).options(**options).load(path))


def write(frame: TidyFrame | DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    df = frame.to_spark() if isinstance(frame, TidyFrame) else frame
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def table(spark: SparkSession, folder: str, name: str, **kwargs) -> TidyFrame:
    """A table of a folder of Parquet tables."""
    return TidyFrame(spark.read.parquet(f"{folder}/{name}.parquet"), **kwargs)
