"""Ranks and running positions within groups of any size, a hot group included.

A plain window sorts each group inside one task, which is right for groups that fit a task and wrong for
one that holds a third of all rows. Groups above ``HOT_ROWS`` take another, equally exact way: the rows are
range-partitioned by (group, order), each partition counts its rows per group, and a running sum over
those few counts gives every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut

#: Rows of one group that a single task may sort.
HOT_ROWS = 200_000


def hot_groups(df: DataFrame, group: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The groups above ``hot_rows``: map-side counted, at most rows / hot_rows of them."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(group)


def split_hot(df: DataFrame, group: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without its hot groups, and the hot groups' rows (None if there are none)."""
    hot = cut(hot_groups(df, group, hot_rows))
    if hot.isEmpty():
        return df, None
    return df.join(hot, group, "left_anti"), df.join(hot, group, "left_semi")


def _ranged(df: DataFrame, group: str, order: list[Column], weight: Column) -> DataFrame:
    """Adds ``_upto``: the group's weight in all rows up to this one, in ``order``, whatever the group's size."""
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = cut(df.repartitionByRange(parts, F.col(group), *order).withColumn("_pid", F.spark_partition_id()))
    per_part = spread.groupBy(group, "_pid").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(group, "_pid", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.withColumn("_in", F.sum(weight).over(inside))
        .join(offsets, [group, "_pid"])
        .withColumn("_upto", F.col("_off") + F.col("_in"))
        .drop("_in", "_off", "_pid")
    )


def number_rows(df: DataFrame, group: str, order: list[Column], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each group in ``order``, which must order the group's rows fully."""
    cold, hot = split_hot(df, group, hot_rows)
    out = cold.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    if hot is None:
        return out
    ranged = _ranged(hot, group, order, F.lit(1)).withColumnRenamed("_upto", name)
    return out.unionByName(ranged.withColumn(name, F.col(name).cast("long")))


def mid_ranks(df: DataFrame, group: str, scores: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Replaces each score by its mid-rank share (mean rank of its ties - 0.5) / n among the group's values.

    n counts the values that are not null; a null keeps the neutral share 0.5.
    """
    cold, hot = split_hot(df, group, hot_rows)
    out = cold
    whole = Window.partitionBy(group)
    for s in scores:
        upto = Window.partitionBy(group).orderBy(F.col(s).asc_nulls_first())
        n = F.count(s).over(whole)
        rank = (F.rank().over(upto) + F.count(F.lit(1)).over(upto)) / 2.0
        nulls = F.count(F.lit(1)).over(whole) - n
        share = F.when(F.col(s).isNull(), F.lit(0.5)).otherwise((rank - nulls - 0.5) / n)
        out = out.withColumn(f"_share_{s}", share)
    out = out.drop(*scores).withColumnsRenamed({f"_share_{s}": s for s in scores})
    if hot is None:
        return out
    ranked = hot
    for s in scores:
        values = hot.where(F.col(s).isNotNull()).groupBy(group, s).agg(F.count(F.lit(1)).alias("_n"))
        totals = values.groupBy(group).agg(F.sum("_n").alias("_all"))
        share = (F.col("_upto") - (F.col("_n") - 1) / 2.0 - 0.5) / F.col("_all")
        shares = _ranged(values, group, [F.col(s)], F.col("_n")).join(totals, group).select(group, s, share.alias(f"_share_{s}"))
        ranked = ranked.join(shares, [group, s], "left").withColumn(f"_share_{s}", F.coalesce(f"_share_{s}", F.lit(0.5)))
    ranked = ranked.drop(*scores).withColumnsRenamed({f"_share_{s}": s for s in scores})
    return out.unionByName(ranked)
