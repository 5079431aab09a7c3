"""Rank fusion over long tables of (query, ranking, key, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def first_ranks(rankings: DataFrame, query: str, key: str) -> DataFrame:
    """(query, ranking, key, rank) with each key once per ranking, ranks closed up after its repeats."""
    once = rankings.groupBy(query, "ranking", key).agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(query, "ranking").orderBy("rank", key)))


def reciprocal_rank(rankings: DataFrame, query: str, key: str, weights: dict[str, float] | None = None, constant: int = RANK_CONSTANT) -> DataFrame:
    """(query, key, score): sum of weight / (constant + rank), to twelve places."""
    weight: Column = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("ranking") == name, F.lit(float(w))).otherwise(weight)
    return rankings.groupBy(query, key).agg(F.round(F.sum(weight / (constant + F.col("rank"))), 12).alias("score"))


def fused(rankings: DataFrame, query: str, key: str, weights: dict[str, float] | None = None, limit: int | None = None, unique: bool = False) -> DataFrame:
    """(query, key, score, rank) of the fused ranking; equal scores in the order of their keys.

    A key counts once in each ranking and its repeats take no rank; ``unique`` says that there are none. With a
    ``limit`` only keys that can be among the best are fused, with all their ranks.
    """
    each = rankings if unique else first_ranks(rankings, query, key)
    out = reciprocal_rank(_contenders(each, query, key, weights, limit) if limit else each, query, key, weights)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), key)))
    return out.where(F.col("rank") <= limit) if limit else out


def contender_depth(weights: list[float], limit: int) -> int:
    """The place beyond which, in all rankings of these weights, no key of the best ``limit`` stands."""
    return int(sum(weights) / min(weights) * (RANK_CONSTANT + limit)) - RANK_CONSTANT + 1


def _contenders(rankings: DataFrame, query: str, key: str, weights: dict[str, float] | None, limit: int) -> DataFrame:
    """The ranks of keys that some ranking has in front, as far as it must be looked at for the best ``limit`` of the fused
    ranking to be among them.

    If any ranking has ``limit`` keys, the last of the best scores its weight / (constant + limit) or more; a key that
    all rankings have beyond place R scores at most all weights / (constant + R). If none has so many, all are in.
    """
    names = [r["ranking"] for r in rankings.select("ranking").distinct().collect()]  # a few
    each = [float((weights or {}).get(n, 1.0)) for n in names]
    if len(names) > 100 or not each or min(each) <= 0:
        return rankings
    depth = contender_depth(each, limit)
    return rankings.join(rankings.where(F.col("rank") <= depth).select(query, key).distinct(), [query, key], "left_semi")


def protected(primary: DataFrame, rankings: DataFrame, query: str, key: str, keep: int = 1, weights: dict[str, float] | None = None, limit: int | None = None, unique: bool = False) -> DataFrame:
    """The first ``keep`` keys of ``primary`` stay in front, the fused rest follows."""
    return diverse_protected([primary], rankings, query, key, keep, weights, limit, unique)


def diverse_protected(sources: list[DataFrame], rankings: DataFrame, query: str, key: str, keep: int = 1, weights: dict[str, float] | None = None, limit: int | None = None, unique: bool = False) -> DataFrame:
    """(query, key, rank): ``keep`` new keys of each source in turn, then the fused rest; only the first ``limit`` if given.

    A source's keys that an earlier source already brought are passed over, however many they are.
    """
    front: DataFrame | None = None
    for n, source in enumerate(sources):
        s = source.select(query, key, F.col("rank"))
        new = s if front is None else s.join(front.select(query, key), [query, key], "left_anti")
        new = new.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy("rank", key))).where(F.col("pos") <= keep)
        new = new.select(query, key, (F.lit(n * keep) + F.col("pos")).alias("pos"))
        front = new if front is None else front.unionByName(new)
    rest = fused(rankings, query, key, weights, limit + keep * len(sources) if limit else None, unique)
    all_keys = reduce(DataFrame.unionByName, [rest.select(query, key), front.select(query, key)]).distinct()
    placed = all_keys.join(front, [query, key], "left").join(rest.select(query, key, F.col("rank").alias("r")), [query, key], "left")
    order = Window.partitionBy(query).orderBy(F.coalesce("pos", F.lit(2**31)), F.coalesce("r", F.lit(2**31)), key)
    out = placed.select(query, key, F.row_number().over(order).alias("rank"))
    return out.where(F.col("rank") <= limit) if limit else out


def complete(ranking: DataFrame, universe: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, rank): the ranking, then every other key of each query's universe in order."""
    seen = universe.select(query, key).distinct().join(ranking.select(query, key, F.col("rank").alias("r")), [query, key], "left")
    return seen.select(query, key, F.row_number().over(Window.partitionBy(query).orderBy(F.coalesce("r", F.lit(2**31)), key)).alias("rank"))
