"""Signal sources and sinks.

A signal frame always has the columns
    signal_id long, entity_id string, actor_key string, ts timestamp
(``ts`` = arrival time = event time).  Sources only ``select`` what they need,
so Catalyst prunes the Parquet scan to those columns and pushes filters down.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.session import ensure_utc

SIGNAL_SCHEMA = T.StructType([
    T.StructField("signal_id", T.LongType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("actor_key", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("sort_order", T.IntegerType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def to_signals(df: DataFrame, signal_id: Column, entity: Column, actor: Column,
               ts: Column) -> DataFrame:
    """A1: project any table onto the signal schema."""
    return df.select(
        signal_id.cast("long").alias("signal_id"),
        entity.cast("string").alias("entity_id"),
        actor.cast("string").alias("actor_key"),
        ts.cast("timestamp").alias("ts"),
    )


def read_signals(spark: SparkSession, path: str, signal_id="signal_id", entity="entity_id",
                 actor="actor_key", ts="ts", fmt: str = "parquet") -> DataFrame:
    """A1: batch signal source from any Spark-readable table."""
    ensure_utc(spark)
    df = spark.read.format(fmt).load(path)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return to_signals(df, col(signal_id), col(entity), col(actor), col(ts))


def stream_signals(spark: SparkSession, path: str, schema: T.StructType, signal_id="signal_id",
                   entity="entity_id", actor="actor_key", ts="ts", fmt: str = "parquet",
                   max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A2: streaming signal source (file source over a folder, optionally
    filtered by a file-name glob; Kafka is a drop-in)."""
    ensure_utc(spark)
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return to_signals(df, col(signal_id), col(entity), col(actor), col(ts))


def parse_payload(df: DataFrame, payload_col: str, field: str = "entity",
                  out: str = "entity_id") -> DataFrame:
    """A3: parse a JSON request body; a malformed body counts as an empty object.

    ``parse_status`` is ``missing_entity`` when the field is absent, null or empty.
    """
    parsed = F.from_json(F.col(payload_col),
                         T.StructType([T.StructField(field, T.StringType())]),
                         {"mode": "PERMISSIVE"})
    ent = F.nullif(parsed.getField(field), F.lit(""))
    return (df.withColumn(out, ent)
              .withColumn("parse_status",
                          F.when(F.col(out).isNull(), F.lit("missing_entity")).otherwise(F.lit("ok"))))


def write_signals(df: DataFrame, path: str, mode: str = "append") -> None:
    """A10: signal sink, Parquet partitioned by UTC date of the hour bucket."""
    out = df.withColumn("date", F.to_date("hour")) if "hour" in df.columns else \
        df.withColumn("date", F.to_date("ts"))
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("date").parquet(path))


def read_signal_sink(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """B0d on the sink: its signals with since <= bucket <= until (naive UTC
    datetimes, known at run time).  The bounds become a range of dates, so only
    the partitions of those days are listed and read, and the bucket range is
    pushed into their files."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.where((F.col("date") >= F.lit(since.date())) & (F.col("hour") >= F.lit(since.replace(tzinfo=dt.timezone.utc))))
    if until is not None:
        df = df.where((F.col("date") <= F.lit(until.date())) & (F.col("hour") <= F.lit(until.replace(tzinfo=dt.timezone.utc))))
    return df.drop("date")


def upsert(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace by key: rows of ``current`` whose key is not in
    ``updates``, plus all of ``updates``.  Callers write the result to a new
    version path (Spark cannot overwrite a path it is reading)."""
    kept = current.join(updates.select(*keys), on=keys, how="left_anti")
    return kept.unionByName(updates.select(*current.columns))
