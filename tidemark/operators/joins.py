"""Joins that Spark lacks or that need care: as-of, bitemporal, interval, tolerance, cascades, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], block: int | None = None) -> DataFrame:
    """left with `take` of the last right row at or before its time (nulls where there is none).

    One union and one sort instead of a range join.  With `block` (a width in units of
    whole-number times) the sort runs per key and block, and only each block's last right row travels on
    to later blocks, so a hot key is spread over its blocks.  Of right rows at the same time
    the greatest struct of `take` holds.  Rows of left without key or time keep nulls.
    """
    names = [f"_t{i}" for i in range(len(take))]
    held = F.struct(*[F.col(c).alias(n) for c, n in zip(take, names, strict=True)])
    r = right.where(F.col(right_time).isNotNull()).groupBy(*by, F.col(right_time).alias("_time")).agg(F.max(held).alias("_held"))
    lefts = left.columns
    rows = left.withColumn("_time", F.col(left_time)).withColumn("_is_left", F.lit(1)).unionByName(r.withColumn("_is_left", F.lit(0)), allowMissingColumns=True)
    if block is None:
        w = Window.partitionBy(*by).orderBy("_time", "_is_left").rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("_held", F.when(F.col("_time").isNotNull(), F.last("_held", ignorenulls=True).over(w)))
    else:
        rows = rows.withColumn("_block", F.floor(F.col("_time") / F.lit(block)))
        w = Window.partitionBy(*by, "_block").orderBy("_time", "_is_left").rowsBetween(Window.unboundedPreceding, 0)
        inner = rows.withColumn("_held", F.last("_held", ignorenulls=True).over(w))
        edge = rows.where("_is_left = 0").groupBy(*by, "_block").agg(F.max_by("_held", "_time").alias("_edge"))
        every = rows.select(*by, "_block").distinct().join(edge, [*by, "_block"], "left")
        before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.withColumn("_carried", F.last("_edge", ignorenulls=True).over(before)).drop("_edge")
        out = inner.join(carried, [*by, "_block"], "left").withColumn("_held", F.coalesce("_held", "_carried"))
    return out.where("_is_left = 1").select(*lefts, *[F.col(f"_held.{n}").alias(c) for c, n in zip(take, names, strict=True)])


def value_as_of(facts: DataFrame, probes: DataFrame, keys: list[str], filed: str, as_of: str, value: str) -> DataFrame:
    """Bitemporal read: per probe the value last filed for its keys at or before `as_of`."""
    return asof_backward(probes, facts, keys, as_of, filed, [value])


def membership_intervals(events: DataFrame, key: str, day: str, action: str) -> DataFrame:
    """(key, valid_from, valid_to) from ADD and REMOVE events; valid_to is exclusive, null while open.

    Of events on the same day the last by precedence (REMOVE, then ADD) holds.
    """
    order = F.when(F.col(action) == "ADD", 1).otherwise(0)
    daily = events.groupBy(key, day).agg(F.max_by(action, order).alias("_act"))
    w = Window.partitionBy(key).orderBy(day)
    turned = daily.withColumn("_prev", F.lag("_act").over(w)).where("_prev is null or _prev <> _act")
    spans = turned.withColumn("valid_to", F.lead(day).over(w))
    return spans.where("_act = 'ADD'").select(key, F.col(day).alias("valid_from"), "valid_to")


def member_on(panel: DataFrame, intervals: DataFrame, key: str, day: str, name: str = "is_member") -> DataFrame:
    """panel with whether its key was a member on its day: an as-of join on the interval starts."""
    marked = asof_backward(panel, intervals, [key], day, "valid_from", ["valid_from", "valid_to"])
    inside = F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to")))
    return marked.withColumn(name, inside).drop("valid_from", "valid_to")


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], day: str, other_day: str, days: int, anti: bool = False) -> DataFrame:
    """Rows of left that have (or have not) a right row of the same keys within `days`.

    Dates are bucketed by the tolerance, so it is an equi-join on key and bucket.
    """
    width = max(1, days)
    bucket = F.floor(F.unix_date(F.col(other_day)) / F.lit(width))
    near = right.where(F.col(other_day).isNotNull()).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.col(other_day).alias("_r_day"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_r_bucket")
    )
    same: Column = F.floor(F.unix_date(F.col(day)) / F.lit(width)) == F.col("_r_bucket")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(near, same & (F.abs(F.datediff(F.col(day), F.col("_r_day"))) <= days), "left_anti" if anti else "left_semi")


def seasonal_predecessor(facts: DataFrame, key: str, period: str, value: str, low: int = 350, high: int = 380) -> DataFrame:
    """facts with the value of the one period that ended low..high days before; null if none or several."""
    width = high - low + 1
    bucket = F.floor(F.unix_date(F.col(period)) / F.lit(width))
    base = facts.select(F.col(key).alias("_k"), F.col(period).alias("_p"), F.col(value).alias("_v"), bucket.alias("_b"))
    first, last = F.date_sub(F.col(period), high), F.date_sub(F.col(period), low)
    probe = facts.select(key, period).distinct().withColumn("_b", F.explode(F.sequence(F.floor(F.unix_date(first) / width), F.floor(F.unix_date(last) / width))))
    hit = probe.join(base, (F.col(key) == F.col("_k")) & (probe["_b"] == base["_b"]) & (F.col("_p") >= first) & (F.col("_p") <= last))
    one = hit.groupBy(key, period).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("previous")).where("_n = 1").drop("_n")
    return facts.join(one, [key, period], "left")


def fallback(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """All of primary, and of secondary the rows whose keys primary lacks."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), keys, "left_anti"))


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row of counts: rows only in a, only in b, in both, and mismatches per column (null-safe)."""
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return x.join(y, keys, "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(both).alias("in_both"),
        *[F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"differ_{c}") for c in columns],
    )


def resolve_names(names: DataFrame, name: str, layers: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """names with `resolved` and `layer`: the first layer (tag, table of (match_key, id), key expression) that knows the name."""
    out, tags, ids = names, [], []
    for i, (tag, lookup, key) in enumerate(layers):
        known = lookup.groupBy(F.col("match_key").alias(f"_k{i}")).agg(F.min("id").alias(f"_id{i}"))
        out = out.join(known, key == F.col(f"_k{i}"), "left")
        ids.append(F.col(f"_id{i}"))
        tags.append(F.when(F.col(f"_id{i}").isNotNull(), F.lit(tag)))
    return out.select(*names.columns, F.coalesce(*ids).alias("resolved"), F.coalesce(*tags).alias("layer"))


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails if a key occurs twice on either side, once its rows are computed."""

    def unique(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        message = F.concat(F.lit(f"key repeated on the {side} side: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
        return df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.when(F.col("_n") > 1, F.raise_error(message).isNull()).otherwise(True)).drop("_n")

    return unique(a, "left").join(unique(b, "right"), keys)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row that is last by `order` (nulls first); combined on the map side, so one row a key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def upsert(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """store with incoming rows replacing those of the same keys."""
    return store.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def append_missing(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent back-fill: only incoming rows whose keys the store lacks."""
    return store.unionByName(incoming.join(store.select(*keys).distinct(), keys, "left_anti"))


def turnover(weights: DataFrame, entity: str, order: str, weight: str) -> DataFrame:
    """(order, turnover): sum of absolute weight changes from one rebalance to the next; names that leave count."""
    dates = weights.select(order).distinct().withColumn("_next", F.lead(order).over(Window.orderBy(order)))
    following = weights.join(dates, order).where("_next is not null").select(entity, F.col("_next").alias(order), F.col(weight).alias("_w0"))
    both = weights.select(entity, order, weight).join(following, [entity, order], "full_outer")
    move = F.abs(F.coalesce(F.col(weight), F.lit(0.0)) - F.coalesce(F.col("_w0"), F.lit(0.0)))
    return both.groupBy(order).agg(F.sum(move).alias("turnover"))
