"""Ordered segments with halos: sequence operators without one task per key.

A key's rows are put into consecutive segments of about `rows` rows, cut at the edges of
slots of its order column; each segment also gets the rows of neighbouring slots
that hold the next `halo` rows before and after it.  An operator that looks at
most `halo` rows around a row then runs inside segments, and a key that holds a
third of all rows is spread over as many tasks as it has segments.

The plan is one small aggregation (a count per key and slot, combined on the map
side), a window over slots (whose number follows time, not rows) and a join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segmented(df: DataFrame, key: str, order: str, slot: int, rows: int = 100_000, halo: int = 512) -> DataFrame:
    """df with `seg` and `own` (false for halo rows, which are copies).

    `order` is a whole number, not null; rows with a null key or order are left out.
    """
    slot_of: Column = F.floor(F.col(order) / F.lit(slot)).cast("long")
    known = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("_slot", slot_of)
    counts = known.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(key).orderBy("_slot")
    upto = F.coalesce(F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def at(rank: Column) -> Column:
        return F.floor(rank / F.lit(rows)).cast("long")

    own = at(F.col("_upto"))
    placed = counts.withColumn("_upto", upto).withColumn("_own", own).withColumn("_before", F.lag("_own").over(by_key))
    segs = F.array_distinct(
        F.array(
            "_own",
            F.coalesce("_before", "_own"),
            at(F.col("_upto") + F.col("_n")),
            at(F.col("_upto") + F.col("_n") + F.lit(halo)),
            at(F.greatest(F.col("_upto") - F.lit(halo), F.lit(0))),
        )
    )
    places = placed.select(key, "_slot", "_own", F.explode(segs).alias("seg"))
    return known.join(places, [key, "_slot"]).withColumn("own", F.col("seg") == F.col("_own")).drop("_slot", "_own")
