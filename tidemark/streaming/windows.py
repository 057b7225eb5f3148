"""Windowed aggregations, deduplication and sinks on streams.

Every function takes and returns a streaming (or batch) DataFrame; ``run_available``
drives one to the end of what its source holds, for replays and tests.
Checkpoints lie in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import _written, shared_folder


def _folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A table's Parquet files as a stream, a few files a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
    zoneless = [c for c, kind in rows.dtypes if kind == "timestamp_ntz"]  # watermarks need instants; the session is in UTC
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def whole_span(rows: DataFrame, time: Column) -> str:
    """Lateness with which no row of a finite table is late or forgotten, in whatever order its files come."""
    first, last = rows.agg(F.unix_micros(F.min(time)), F.unix_micros(F.max(time))).first()
    return f"{0 if first is None else (last - first) // 1_000_000 + 2} seconds"


def tumbling(df: DataFrame, time: str, width: str, by: list[str], aggregates: list[Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates per fixed window; rows later than `late` are dropped once their window is out."""
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(*aggregates)


def sliding(df: DataFrame, time: str, width: str, slide: str, by: list[str], aggregates: list[Column], late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, width, slide).alias("w"), *by).agg(*aggregates)


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggregates: list[Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates per session: a pause of `gap` ends one."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggregates)


def deduplicate(df: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """First delivery of each key; a key's state is kept for `late` and then dropped."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over all its source holds now and returns the result table, which lies in the shared folder.

    Appended rows go to the exactly-once file sink; a complete result replaces the table with each batch.
    """
    spark = df.sparkSession
    path = _folder(spark, label)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", _folder(spark, f"{label}-ck")).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_arrivals(rows: DataFrame, arrival: str, arrivals: list[int], plan, label: str) -> DataFrame:
    """Delivers a table in arrivals, one after the other, and runs a stream in append mode on each; returns its table.

    plan maps the source stream to the result stream.  The stream is stopped after each arrival and resumed
    from its checkpoint, so state, watermark and sink outlive restarts; each arrival is one batch, however many files it has.
    """
    spark = rows.sparkSession
    source, path, marks = (_folder(spark, f"{label}-{c}") for c in ("in", "out", "ck"))
    result = None
    for number in arrivals:
        rows.where(F.col(arrival) == number).drop(arrival).write.mode("append").parquet(source)
        result = plan(spark.readStream.schema(rows.drop(arrival).schema).parquet(source))
        query = result.writeStream.outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).format("parquet").start(path)
        query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def partitioned_sink(df: DataFrame, partitions: list[str], label: str) -> DataFrame:
    """Appends a stream to Parquet by partition, exactly once, and returns the table."""
    spark = df.sparkSession
    path = _folder(spark, label)
    query = df.writeStream.partitionBy(*partitions).format("parquet").option("checkpointLocation", _folder(spark, f"{label}-ck")).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.parquet(path)
