"""Problem 1: one ranking per group from several scores on unlike scales.

First principal component of the rank-transformed scores. The ranks are taken within the group, so neither a
score's range nor its shape counts; the correlation matrix is one distributed aggregate over all groups, and
only its 14 sums reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.positions import HOT_ROWS, mid_ranks, number_rows
from quillmesh.session import cut


def principal_loadings(shares: DataFrame, scores: list[str]) -> list[float]:
    """Loadings of the first component, each with the sign of its score's direction (all point upwards here).

    The direction that a caller declares holds: a score that the component would count against it counts for it, at
    the same weight, so the result is then no longer the component's own projection. (In the project's tables all
    four point the same way.) A score without variance has correlation 0 with the rest. If the first component is not unique, no score
    is preferred: the loadings are then equal.
    """
    sums = [F.sum(F.col(s) - 0.5).alias(f"s_{s}") for s in scores]
    sums += [F.sum((F.col(a) - 0.5) * (F.col(b) - 0.5)).alias(f"p_{i}_{j}") for i, a in enumerate(scores) for j, b in enumerate(scores) if i <= j]
    row = shares.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    k, n = len(scores), row["n"]
    if not n:
        return [k**-0.5] * k
    mean = np.array([row[f"s_{s}"] / n for s in scores])
    cov = np.array([[row[f"p_{min(i, j)}_{max(i, j)}"] / n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    safe = np.where(sd > 1e-9, sd, 1.0)
    corr = cov / np.outer(safe, safe)
    np.fill_diagonal(corr, 1.0)
    values, vectors = np.linalg.eigh(corr)
    if k > 1 and values[-1] - values[-2] < 1e-9:
        return [k**-0.5] * k
    return [float(abs(v)) for v in vectors[:, -1]]


def fused_scores(df: DataFrame, group: str, item: str, directions: dict[str, int], latest: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, item, fused): the projection of each item's rank-transformed scores on the first component.

    ``directions`` gives 1 for a score whose high values are good and -1 for the opposite. A row delivered
    again under the same (group, item) counts once, in its ``latest`` delivery. Null and NaN scores are
    unknown and take the group's neutral rank; infinite ones are the extremes they are. Rows without a group
    or item cannot be ranked and are left out. Other columns of ``df`` are ignored.
    """
    scores = [f"score_{i}" for i in range(len(directions))]
    clean = [F.when(F.isnan(c) | c.isNull(), None).otherwise(c * sign).alias(s) for s, (c, sign) in zip(scores, ((F.col(name).cast("double"), sign) for name, sign in directions.items()))]
    when = F.col(latest) if latest else F.lit(0)
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item, when.alias("_at"), *clean)
    once = rows.groupBy(group, item).agg(F.max(F.struct("_at", *scores)).alias("_r")).select(group, item, *(F.col(f"_r.{s}").alias(s) for s in scores))
    shares = cut(mid_ranks(once, group, scores, hot_rows))
    loadings = principal_loadings(shares, scores)
    return shares.select(group, item, sum((F.lit(w) * (F.col(s) - 0.5) for w, s in zip(loadings, scores)), F.lit(0.0)).alias("fused"))


def fused_first(df: DataFrame, group: str, item: str, directions: dict[str, int], latest: str | None = None) -> DataFrame:
    """(group, item): the item ranked first in each group; of equal projections, the lowest item."""
    fused = fused_scores(df, group, item, directions, latest)
    best = fused.groupBy(group).agg(F.min(F.struct((-F.col("fused")).alias("f"), F.col(item).alias("i"))).alias("b"))
    return best.select(group, F.col("b.i").alias(item))


def fused_ranking(df: DataFrame, group: str, item: str, directions: dict[str, int], latest: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, item, fused, position): every item at its position, 1 being the best."""
    fused = fused_scores(df, group, item, directions, latest, hot_rows)
    return number_rows(fused, group, [F.col("fused").desc(), F.col(item)], "position", hot_rows)
