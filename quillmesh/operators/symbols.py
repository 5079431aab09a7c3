"""The symbol ranking of a stated set of cues, scored cue by cue over all files as in ``held``: a term that many names or
paths hold makes every file of them meet every cue with that term, so their product is neither written nor shuffled."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import blocks, held, lexical
from quillmesh.session import cut

#: A score and a name's length, which is below it, in one number.
_SPAN = 2**20


class Symbols(NamedTuple):
    """Files in order of their keys and what the cues' terms meet: by term names (with what the match is worth) and paths;
    by name where it stands and how long it is."""

    keys: pa.Array
    cues: list
    terms: list[np.ndarray]
    sizes: list[int]
    rarity: np.ndarray
    inside: held.Lists
    paths: held.Lists
    pool: held.Lists
    least: np.ndarray
    kinds: tuple[str, str]
    wanted: held.Lists | None = None


def hold(labels: DataFrame, key: str, label: str, cues: DataFrame, cue: str, text: str) -> Symbols | None:
    """What ``lexical.symbol_scores`` scores, or None if that is too much to be sent."""
    asked, words, pool, inside, rarity = lexical.symbol_terms(labels, key, label, cues, cue, text)
    pool = cut(pool.select(key, "low", F.least(F.length("name"), F.lit(_SPAN - 1)).cast("double").alias("length")))
    tier = F.when(F.col("low") == F.col("term"), 1000.0).when(F.col("low").startswith(F.col("term")), 100.0).otherwise(0.0)
    inside = cut(inside.select("low", "term", tier.alias("tier")))
    files = pool.select(key).distinct()
    places = cut(lexical._holding(files.withColumn("_low", F.lower(key)), "_low", words).select(key, "term"))
    n_pool, n_inside, n_places = pool.count(), inside.count(), places.count()
    if max(n_pool, n_inside, n_places) > held.HELD:
        return None

    def ordered(df: DataFrame) -> pa.Array:
        values = held.whole_of(df.toArrow().column(0))
        return values.take(pc.sort_indices(values))

    def numbers(column: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
        return pc.index_in(held.whole_of(column), known).to_numpy(zero_copy_only=False).astype(np.int32)

    keys, names, terms = ordered(files), ordered(inside.select("low").distinct()), ordered(words)
    rare = {r["term"]: r["w"] for r in rarity.collect()}

    def listed(df: DataFrame, by: str, n: int, of: pa.Array, values: str, known: pa.Array, worth: str | None = None) -> held.Lists:
        got = [(numbers(t.column(by), of), numbers(t.column(values), known), t.column(worth).to_numpy() if worth else np.zeros(0)) for t in held.parts(df, values, n)]
        at, value, amount = (np.concatenate(x) for x in zip(*got))
        return held.Lists.of(at, value, len(of), amount.astype(np.float32) if worth else None)

    found = listed(pool.join(inside.select("low").distinct(), "low", "left_semi"), "low", n_pool, names, key, keys, "length")
    least = np.full(len(keys), _SPAN, dtype=np.int64)
    for t in held.parts(pool.groupBy(key).agg(F.min("length").alias("length")), key, n_pool):
        least[numbers(t.column(key), keys)] = t.column("length").to_numpy()
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    by_cue: dict = {}
    for r in asked.collect():
        by_cue.setdefault(r[cue], (r["n"], []))[1].append(number[r["term"]])
    every = sorted(by_cue)
    kinds = labels.schema[key].dataType.simpleString(), cues.schema[cue].dataType.simpleString()
    return Symbols(keys, every, [np.array(by_cue[c][1], dtype=np.int64) for c in every], [by_cue[c][0] for c in every], np.array([rare[t] for t in terms.to_pylist()]), listed(inside, "term", n_inside, terms, "low", names, "tier"), listed(places, "term", n_places, terms, key, keys), found, least, kinds)


def _met(lists: held.Lists, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Values, their worth, and the position in ``numbers`` of the one that each belongs to."""
    at = lists.slices(numbers)
    values = np.concatenate([lists.values[s] for s in at]) if at else np.zeros(0, dtype=np.int32)
    worth = None if lists.worth is None else np.concatenate([lists.worth[s] for s in at]) if at else np.zeros(0)
    return values, worth, np.repeat(np.arange(len(at)), [s.stop - s.start for s in at])


def _order(s: Symbols, number: int) -> np.ndarray:
    """The files of a score above 0: by score, the length of the best name, and key."""
    terms, n = s.terms[number], len(s.keys)
    rarity = s.rarity[terms]
    files, _, of = _met(s.paths, terms)
    place = np.bincount(files, 0.5 * rarity[of], n).astype(float)
    low, tier, of = _met(s.inside, terms)
    names, at = np.unique(low, return_inverse=True)
    tiered = np.bincount(at, tier.astype(float) * rarity[of], len(names))
    plain = np.bincount(at, np.where(tier == 0, rarity[of], 0.0), len(names))
    value = plain + np.where(tiered > 0, tiered * np.power(np.bincount(at, minlength=len(names)) / s.sizes[number], 2.0), 0.0)
    files, length, of = _met(s.pool, names)
    best = np.where(place > 0, blocks.units(place) * _SPAN - s.least, 0)
    np.maximum.at(best, files, blocks.units(value[of] + place[files]) * _SPAN - length.astype(np.int64))
    found = np.flatnonzero(best > 0)
    return found[np.argsort(-best[found], kind="stable")]


def _ranks(s: Symbols, number: int, places: np.ndarray, rank: np.ndarray, cue: str, key: str) -> pa.RecordBatch:
    own = pa.array([s.cues[number]]).take(pa.array(np.zeros(len(places), dtype=np.int64)))
    return pa.RecordBatch.from_arrays([own, s.keys.take(pa.array(places)), pa.array(rank)], [cue, key, "rank"])


def front(s: Symbols, spark: SparkSession, cue: str, key: str, top: int) -> DataFrame:
    """(cue, key, rank) of the ``top`` best files of each cue."""

    def work(known: Symbols, number: int) -> pa.RecordBatch:
        order = _order(known, number)[:top]
        return _ranks(known, number, order, np.arange(1, len(order) + 1), cue, key)

    return held.each_cue(spark, s, len(s.cues), work, f"{cue} {s.kinds[1]}, {key} {s.kinds[0]}, rank long")


def placed(s: Symbols, pairs: DataFrame, cue: str, key: str) -> DataFrame:
    """(cue, key, rank) of those of the given (cue, key) that have a score, however deep they stand."""
    pairs = cut(pairs.select(cue, key).distinct())
    of, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for t in held.parts(pairs, key, pairs.count(), held.PART // 4):
        own = pc.fill_null(pc.index_in(held.whole_of(t.column(cue)), pa.array(s.cues, t.schema.field(cue).type)), -1).to_numpy()
        place = pc.fill_null(pc.index_in(held.whole_of(t.column(key)), s.keys), -1).to_numpy()
        of.append(own[(own >= 0) & (place >= 0)])
        at.append(place[(own >= 0) & (place >= 0)])
    wanted = held.Lists.of(np.concatenate(of), np.concatenate(at), len(s.cues))

    def work(known: Symbols, number: int) -> pa.RecordBatch | None:
        places = known.wanted.values[known.wanted.slices([number])[0]]
        if not len(places):
            return None
        order = _order(known, number)
        rank = np.zeros(len(known.keys), dtype=np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        places = places[rank[places] > 0]
        return _ranks(known, number, places, rank[places], cue, key)

    return held.each_cue(pairs.sparkSession, s._replace(wanted=wanted), len(s.cues), work, f"{cue} {s.kinds[1]}, {key} {s.kinds[0]}, rank long")
