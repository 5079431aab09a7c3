"""The complete scorer of notes: bounded seeds of three channels, support of the graph, use, goals and waste.

Every step is a join or an aggregate that combines; the channels that a caller does not have are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import graph
from quillmesh.session import cut

# Fixed values of the scorer.
TEST_DAMP, COSINE_FLOOR, SEMANTIC_WEIGHT = 0.5, 0.3, 2.0
ASSOCIATION_WEIGHT, ASSOCIATION_OVERLAP, ASSOCIATION_FULL = 0.5, 2, 4.0
STRENGTH_LOW, STRENGTH_SPAN, GOAL_SPAN, WASTE_RUN, WASTE_DAMP, PINNED_FLOOR = 0.8, 0.4, 0.3, 3, 0.8, 0.5


def damped(lexical: DataFrame, tagged: DataFrame, query: str) -> DataFrame:
    """``lexical`` (query, node, amount) with the notes of ``tagged`` (node), which are tests, at half."""
    marked = lexical.join(tagged.select("node").distinct().withColumn("_t", F.lit(True)), "node", "left")
    return marked.select(query, "node", F.when(F.col("_t"), F.col("amount") * TEST_DAMP).otherwise(F.col("amount")).alias("amount"))


def semantic(cosines: DataFrame, query: str) -> DataFrame:
    """(query, node, amount) of (query, node, weight, cosine): twice the weighted cosine above the floor, over a query's cues."""
    above = cosines.where(F.col("cosine") > COSINE_FLOOR)
    return above.groupBy(query, "node").agg((SEMANTIC_WEIGHT * F.sum(F.col("weight") * (F.col("cosine") - COSINE_FLOOR))).alias("amount"))


def associated(cue_terms: DataFrame, learned: DataFrame, query: str) -> DataFrame:
    """(query, node, amount): what was learned for a note (node, term, w) and shares two terms or more with the cues'
    (query, term). Terms meet by equality."""
    met = learned.distinct().join(cue_terms.select(query, "term").distinct(), "term").groupBy(query, "node").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"))
    return met.where(F.col("n") >= ASSOCIATION_OVERLAP).select(query, "node", (ASSOCIATION_WEIGHT * F.col("w") * F.least(F.lit(1.0), F.col("n") / ASSOCIATION_FULL)).alias("amount"))


def seeds(lexical: DataFrame, query: str, excluded: DataFrame | None = None, *bounded: DataFrame) -> DataFrame:
    """(query, node, amount, words, top): lexical amounts plus those of further channels, each bounded by the orphan cap
    of the query's best lexical amount among notes that are not ``excluded`` (node)."""
    allowed = lexical if excluded is None else lexical.join(excluded.select("node").distinct(), "node", "left_anti")
    top = allowed.groupBy(query).agg(F.max("amount").alias("top"))
    rows = lexical.select(query, "node", F.col("amount").alias("words"), F.lit(0.0).alias("more"))
    for channel in bounded:
        capped = channel.join(top, query, "left").select(query, "node", F.lit(0.0).alias("words"), F.when(F.coalesce("top", F.lit(0.0)) > 0, F.least("amount", F.col("top") * graph.ORPHAN_CAP)).otherwise(F.col("amount")).alias("more"))
        rows = rows.unionByName(capped)
    each = rows.groupBy(query, "node").agg(F.sum("words").alias("words"), F.sum("more").alias("more"))
    return each.join(top, query, "left").select(query, "node", (F.col("words") + F.col("more")).alias("amount"), "words", F.coalesce("top", F.lit(0.0)).alias("top"))


def prior(strength: DataFrame) -> DataFrame:
    """(node, prior): what draws flow to a note, from its strength."""
    return strength.select("node", (graph.BASE_PRIOR + F.col("strength")).alias("prior"))


def floored(strength: DataFrame, pinned: DataFrame) -> DataFrame:
    """(node, strength): strengths with the floor of pinned notes (node), which need not have been used."""
    held = pinned.select("node").distinct().withColumn("_p", F.lit(PINNED_FLOOR))
    both = strength.select("node", "strength").join(held, "node", "full")
    return both.select("node", F.greatest(F.coalesce("strength", F.lit(0.0)), F.coalesce("_p", F.lit(0.0))).alias("strength"))


def activate(seeded: DataFrame, pairs: DataFrame, query: str, strength: DataFrame | None = None, goals: DataFrame | None = None, wasted: DataFrame | None = None, steps: int = graph.STEPS, carriers: bool = False) -> DataFrame:
    """(query, node, score): seeds (from ``seeds``), three damped steps over undirected pairs, and what use says of a note.

    A lexical hit gains at most half from the walk; what only other channels and the walk reach stays below 0.4 of the
    query's best lexical amount, and what only the walk reaches without any such is left out. With ``strength``
    (node, strength), scores are scaled by it, by the best goal (node, goal) and by waste (node). ``carriers``
    adds words, walk, carrier and hop: what to say of a result.
    """
    seeded = cut(seeded)
    flow = graph.shares(graph.adjacency(pairs), prior(strength) if strength is not None else None)
    reached = graph.walk(seeded.select(query, "node", "amount"), flow, steps, query=query, carriers=carriers) if steps else None
    tops = seeded.groupBy(query).agg(F.max("top").alias("top"))
    both = seeded.drop("top") if reached is None else seeded.drop("top").join(reached, [query, "node"], "full")
    both = both.join(tops, query, "left")
    d, words, walk, top = (F.coalesce(c, F.lit(0.0)) for c in ("amount", "words", F.lit(0.0) if reached is None else "walk", "top"))
    gained = d * (1 + F.when(walk > 0, graph.WALK_GAIN_CAP * walk / (walk + d)).otherwise(0.0))
    relevance = F.when(words > 0, gained).when((top > 0) & ((d > 0) | (walk > 0)), F.least(d + walk, top * graph.ORPHAN_CAP)).when(d > 0, d + walk)
    scored = both.withColumn("_rel", relevance).where(F.col("_rel").isNotNull())
    if strength is not None:
        scored = scored.join(strength.select("node", "strength"), "node", "left")
        factor = STRENGTH_LOW + STRENGTH_SPAN * F.least(F.lit(1.0), F.coalesce("strength", F.lit(0.0)))
        if goals is not None:
            scored = scored.join(goals.groupBy("node").agg(F.max("goal").alias("goal")), "node", "left")
            factor = factor * (1 + GOAL_SPAN * F.least(F.lit(1.0), F.coalesce("goal", F.lit(0.0))))
        if wasted is not None:
            scored = scored.join(wasted.select("node").distinct().withColumn("_w", F.lit(True)), "node", "left")
            factor = factor * F.when(F.col("_w"), WASTE_DAMP).otherwise(1.0)
        scored = scored.withColumn("_rel", F.col("_rel") * factor)
    told = [words.alias("words"), walk.alias("walk"), "carrier", "hop"] if carriers else []
    return scored.select(query, "node", F.round("_rel", 6).alias("score"), *told)


def why(scored: DataFrame, query: str) -> DataFrame:
    """(query, node, why): one line on each result of ``activate`` with carriers: what matched, what carried it."""
    parts = F.concat_ws(
        "; ",
        F.when(F.col("words") > 0, F.concat(F.lit("words "), F.format_number("words", 3))),
        F.when(F.col("carrier").isNotNull(), F.concat(F.lit("via "), "carrier", F.lit(" in "), F.col("hop").cast("string"), F.when(F.col("hop") == 1, " step").otherwise(" steps"))),
        F.concat(F.lit("score "), F.format_number("score", 3)),
    )
    return scored.select(query, "node", parts.alias("why"))
