"""Session factory and the small runtime helpers every operator shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None
_written: list[tuple[SparkSession, str]] = []


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one Parquet table; filters and columns are pushed down by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one of our own, which a cluster could not see and so refuses."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        _own_folder = _own_folder or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        folder = _own_folder
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back.

    Cuts lineage so that a result used more than once is computed once, and
    survives the loss of executors.  The files are removed at interpreter exit.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            continue
    _written.clear()


_cached: dict[tuple, tuple[str, object]] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """(length, latest change) of a file or folder, by the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(target)
    changes = [status.getModificationTime()] + ([f.getModificationTime() for f in fs.listStatus(target)] if status.isDirectory() else [])
    return fs.getContentSummary(target).getLength(), max(changes)


def cached(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], label: str, build) -> DataFrame:
    """build() written once a session and read from then on, until a file of the tables changes."""
    key = (spark.sparkContext.applicationId, label, sf_dir, *[_state(spark, f"{sf_dir}/{t}.parquet") for t in tables])
    if key not in _cached:
        df = materialise(build(), label)
        _cached[key] = df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else "", df.schema
        if not _cached[key][0]:
            return df
    path, schema = _cached[key]
    return spark.read.schema(schema).parquet(path)


def predecessor(df: DataFrame, key: str, order: str, out: str, width: int = 1 << 16) -> DataFrame:
    """For each (key, order) row the previous `order` of its key, without one task per key.

    A window per key would put a hot key into one task.  The rows are cut into
    ranges of `width` units of `order`; a window runs inside each range, and only
    the ranges' first and last values (one row a range) meet in a window per key.
    Expects unique (key, order); `order` is a whole number.
    """
    from pyspark.sql import Window

    span = F.floor(F.col(order) / F.lit(width)).cast("long")
    cut = df.withColumn("_range", span)
    inner = Window.partitionBy(key, "_range").orderBy(order)
    within = cut.withColumn(out, F.lag(order).over(inner))
    edges = cut.groupBy(key, "_range").agg(F.max(order).alias("_last"))
    before = edges.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_range"))).select(key, "_range", "_before")
    return (
        within.join(before, [key, "_range"], "left")
        .withColumn(out, F.coalesce(out, "_before"))
        .drop("_range", "_before")
    )
