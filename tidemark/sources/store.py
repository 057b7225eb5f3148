"""Stores in the shared folder: bars by ticker and year, append-only JSON-lines journals, archives."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import keep_last
from tidemark.session import _written, shared_folder


def _temporary(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@dataclass
class BarStore:
    """Daily or weekly bars in Parquet, partitioned by ticker and year."""

    spark: SparkSession
    path: str

    @staticmethod
    def temporary(spark: SparkSession, label: str) -> "BarStore":
        return BarStore(spark, _temporary(spark, label))

    def write(self, bars: DataFrame, mode: str = "overwrite") -> None:
        """One sorted file per ticker and year; a hot partition is split by Spark's own file size setting."""
        yearly = bars.withColumn("year", F.year("date"))
        yearly.repartition("ticker", "year").sortWithinPartitions("date").write.mode(mode).partitionBy("ticker", "year").parquet(self.path)

    def load(self, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows of the tickers in [start, end]: partitions are pruned by ticker and year, row groups by date."""
        df = self.spark.read.parquet(self.path)
        if tickers is not None:
            df = df.where(F.col("ticker").isin(tickers))
        if start is not None:
            df = df.where((F.col("year") >= int(start[:4])) & (F.col("date") >= F.lit(start).cast("date")))
        if end is not None:
            df = df.where((F.col("year") <= int(end[:4])) & (F.col("date") <= F.lit(end).cast("date")))
        return df.drop("year")

    def latest(self) -> DataFrame:
        return keep_last(self.load(), ["ticker"], ["date"])


@dataclass
class Journal:
    """Append-only JSON lines; an entry is written once per key, and the latest by `order` holds."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    order: str

    @staticmethod
    def temporary(spark: SparkSession, label: str, schema: str, keys: list[str], order: str) -> "Journal":
        return Journal(spark, _temporary(spark, label), schema, keys, order)

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).json(self.path, mode="PERMISSIVE")
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        """Adds the rows whose key and order the journal lacks."""
        new = rows.join(self.entries().select(*self.keys, self.order).distinct(), [*self.keys, self.order], "left_anti")
        new.write.mode("append").json(self.path)

    def latest(self) -> DataFrame:
        return keep_last(self.entries(), self.keys, [self.order])


#: Lines of a member that are handed on at once.
LINES = 20_000


def read_archives(files: DataFrame) -> DataFrame:
    """(path, member, sha256, line_no, raw) of the text members of ZIP archives (path, content); members are read line by line."""

    def unzip(frames):
        import io
        import itertools
        import zipfile

        import pandas as pd

        for frame in frames:
            for p, content, digest in zip(frame["path"], frame["content"], frame["sha256"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        with z.open(member) as stream:
                            text, at = io.TextIOWrapper(stream, "utf-8", errors="replace"), 0
                            while part := [line.rstrip("\r\n") for line in itertools.islice(text, LINES)]:
                                yield pd.DataFrame({"path": p, "member": member, "sha256": digest, "line_no": range(at + 1, at + len(part) + 1), "raw": part})
                                at += len(part)

    hashed = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    return hashed.mapInPandas(unzip, "path string, member string, sha256 string, line_no bigint, raw string")


def read_zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """The archives' lines under a path."""
    return read_archives(spark.read.format("binaryFile").load(path).select("path", "content"))


def pack_archives(lines: DataFrame, header: str) -> DataFrame:
    """(path, content): one ZIP archive a path of rows (path, line, header), with the header line where `header` says so."""

    def pack(pdf):
        import io
        import zipfile

        import pandas as pd

        content = io.BytesIO()
        with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("trades.csv", "\n".join(([header] if pdf["header"].iloc[0] else []) + sorted(pdf["line"])) + "\n")
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [content.getvalue()]})

    return lines.groupBy("path").applyInPandas(pack, "path string, content binary")


def parse_trades(rows: DataFrame) -> DataFrame:
    """Typed trades of archive lines; a header is a first line whose id is no number, flags may be true, True, 1 and the like."""
    cut = F.split("raw", ",")
    flag = F.lower(F.trim(cut[3]))
    typed = rows.select(
        "path", "sha256", "line_no", F.trim(cut[0]).try_cast("bigint").alias("agg_trade_id"), F.trim(cut[1]).try_cast("double").alias("price"), F.trim(cut[2]).try_cast("bigint").alias("exchange_ts_ns"),
        F.when(flag.isin("true", "1", "t"), True).when(flag.isin("false", "0", "f"), False).alias("is_buyer_maker"),
    )
    return typed.where("not (line_no = 1 and agg_trade_id is null)")
