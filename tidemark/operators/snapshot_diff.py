"""What changed between full snapshots, by content-defined chunks.

A key-sorted snapshot is cut where the hash of a key says so, thus at the same
keys in every snapshot, wherever rows were inserted or dropped.  Chunks with the
same digest in both snapshots are discarded without looking at their rows; only
the rows of the others are joined and classified as added, removed or changed.

Defined cases: an empty snapshot against a full one gives all rows as added or
removed; rows equal in all compared fields give nothing; null fields equal null
fields; rows without a key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk ends where the key's hash is divisible by this: about as many rows a chunk.
CHUNK_ROWS = 16


def chunk_rows(items: list[tuple[str, str]], every: int = CHUNK_ROWS) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(digest, rows) of each chunk of key-sorted (key, content) rows."""
    part: list[tuple[str, str]] = []
    for key, content in items:
        if part and xxhash.xxh64_intdigest(key) % every == 0:
            yield _digest(part), part
            part = []
        part.append((key, content))
    if part:
        yield _digest(part), part


def _digest(part: list[tuple[str, str]]) -> int:
    h = xxhash.xxh64()
    for key, content in part:
        h.update(f"{len(key)}:{key}{len(content)}:{content}")
    return h.intdigest() - (1 << 63)


def compare_chunks(chunks: DataFrame) -> DataFrame:
    """(pair, key, change_kind) from chunks (pair, side 0 old or 1 new, digest, keys, contents)."""
    # any chunk seen on both sides has the same rows there, so it drops out whole
    unmatched = (
        chunks.groupBy("pair", "digest")
        .agg(F.bit_or(F.col("side") + 1).alias("sides"), F.min("keys").alias("keys"), F.min("contents").alias("contents"))
        .where("sides <> 3")
        .select("pair", (F.col("sides") - 1).alias("side"), F.explode(F.arrays_zip("keys", "contents")).alias("row"))
        .select("pair", "side", F.col("row.keys").alias("key"), F.col("row.contents").alias("content"))
    )
    return classify(unmatched)


def classify(rows: DataFrame) -> DataFrame:
    """(pair, key, change_kind) from rows (pair, side, key, content): the full outer join of old and new, as one shuffle."""
    joined = rows.groupBy("pair", "key").agg(
        F.max(F.when(F.col("side") == 0, F.col("content"))).alias("old"),
        F.max(F.when(F.col("side") == 1, F.col("content"))).alias("new"),
    )
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return joined.where(~F.col("old").eqNullSafe(F.col("new"))).select("pair", "key", kind.alias("change_kind"))


def unmatched_rows(old: list[tuple[str, str]], new: list[tuple[str, str]], every: int = CHUNK_ROWS) -> Iterator[tuple[int, str, str]]:
    """(side, key, content) of the rows in chunks that only one of two key-sorted snapshots has."""
    chunks = [dict(chunk_rows(items, every)) for items in (old, new)]
    for side in (0, 1):
        for digest, part in chunks[side].items():
            if digest not in chunks[1 - side]:
                for key, content in part:
                    yield side, key, content


def _frame_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows (bucket, side, key, content) that come sorted by bucket, side, key."""
    schema = pa.schema([("pair", pa.int64()), ("side", pa.int32()), ("digest", pa.int64()), ("keys", pa.list_(pa.string())), ("contents", pa.list_(pa.string()))])
    open_at, items = None, []

    def flush():
        out: dict[str, list] = {n: [] for n in schema.names}
        for digest, part in chunk_rows(items):
            for n, v in zip(schema.names, (open_at[0], open_at[1], digest, [k for k, _ in part], [x for _, x in part]), strict=True):
                out[n].append(v)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    for batch in batches:
        for bucket, side, key, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (bucket, side) != open_at:
                if items:
                    yield flush()
                open_at, items = (bucket, side), []
            items.append((key, content))
    if items:
        yield flush()


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """(key, change_kind) between two snapshots of a table too large for one task.

    Rows are hashed by key into buckets, key-sorted and chunked inside each; every
    bucket is a snapshot pair of its own, so no task sees more than its bucket.
    `key` is the key columns joined by '|'.  Repeated keys keep the greatest row.
    """
    fields = fields or sorted((set(old.columns) & set(new.columns)) - set(keys))

    def side(df: DataFrame, n: int) -> DataFrame:
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        content = F.to_json(F.struct(*[F.col(f) for f in fields])) if fields else F.lit("")
        rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(key.alias("key"), content.alias("content"))
        return rows.groupBy("key").agg(F.max("content").alias("content")).select(
            F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.lit(n).alias("side"), "key", "content"
        )

    rows = side(old, 0).unionByName(side(new, 1)).repartition("bucket", "side").sortWithinPartitions("bucket", "side", "key")
    chunks = rows.mapInArrow(_frame_chunks, "pair bigint, side int, digest bigint, keys array<string>, contents array<string>")
    return compare_chunks(chunks).select("key", "change_kind")
