"""Rankings of a stated set of cues for which every document counts, scored cue by cue.

A walk over a graph or a complete ranking needs all documents of a cue at once, and the scores by cue and document are
the product of both. So what the cues' terms meet, the graph and what is known of each document are sent to every task
as arrays, and a task scores one cue after the other over all documents: nothing of the product is written or
shuffled but what is asked. Arrays beyond HELD rows are not sent; callers then join as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import activation, blocks, graph, recall
from quillmesh.session import cut, spread

#: Rows (of hits, of links and of amounts, each) up to which they are sent to every task.
HELD = 50_000_000
#: Rows that the driver takes at once.
PART = 1_000_000
#: Rows that leave a task at once.
SLICE = 32_768


class Lists(NamedTuple):
    """Values by number: those of number i from starts[i] on."""

    starts: np.ndarray
    values: np.ndarray
    worth: np.ndarray | None = None

    @classmethod
    def of(cls, numbers: np.ndarray, values: np.ndarray, n: int, worth: np.ndarray | None = None) -> Lists:
        order = np.argsort(numbers, kind="stable")
        starts = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.bincount(numbers, minlength=n), out=starts[1:])
        return cls(starts, values[order].astype(np.int32), None if worth is None else worth[order])

    def slices(self, numbers: np.ndarray) -> list[slice]:
        return [slice(self.starts[i], self.starts[i + 1]) for i in numbers]

    def sums(self, numbers: np.ndarray, n: int) -> np.ndarray:
        """The summed worth of each of ``n`` values over the given numbers, or how often it is there."""
        at = self.slices(numbers)
        if not at:
            return np.zeros(n)
        worth = np.concatenate([self.worth[s] for s in at]) if self.worth is not None else None
        return np.bincount(np.concatenate([self.values[s] for s in at]), worth, n).astype(float)


class Held(NamedTuple):
    """All documents in order of their keys, the hits of the cues' terms, and the cues."""

    keys: pa.Array
    cues: list
    terms: list[np.ndarray]
    sizes: list[int]
    vocabulary: list[str]
    hits: Lists
    kinds: tuple[str, str]

    def place(self, keys: pa.ChunkedArray) -> np.ndarray:
        """The places of given keys, -1 for one that there is not."""
        return pc.fill_null(pc.index_in(whole_of(keys), self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def units(self, number: int) -> np.ndarray:
        """The overlap score of each document, in millionths."""
        return blocks.units(self.hits.sums(self.terms[number], len(self.keys)) / max(1, self.sizes[number]))


def parts(df: DataFrame, key: str, rows: int, most: int = PART) -> Iterator[pa.Table]:
    """The rows of ``df``, of which there are about ``rows``, in parts of about ``most``, so that the driver holds few."""
    n = max(1, -(-rows // most))
    for i in range(n):
        yield (df if n == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)).toArrow().combine_chunks()


def whole_of(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def hold(docs: DataFrame, key: str, fields: dict[str, Column], cues: DataFrame, terms: DataFrame, cue: str, weights: dict[str, float]) -> Held | None:
    """The documents and what they hold of the terms of ``terms`` (cue, term, n_terms), for all of ``cues`` (cue); None
    if that is too much to be sent. Documents are read and split into words once; ``key`` is unique."""
    asked = terms.select(cue, "term", "n_terms").toPandas()
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(asked["term"]))}
    names, sent = list(fields), docs.sparkSession.sparkContext.broadcast(vocabulary)
    worths = [weights.get(name, 0.0) for name in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            counts, ids, worth = [], [], []
            for texts in zip(*(batch.column(1 + i).to_pylist() for i in range(len(names)))):
                of: dict[int, float] = {}
                for text, w in zip(texts, worths):
                    for term in set(T.term_list(text)) if w else ():
                        if (i := known.get(term)) is not None:
                            of[i] = of.get(i, 0.0) + w
                counts.append(len(of))
                ids += of
                worth += of.values()
            starts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(starts, pa.array(worth, pa.float32()))], [key, "ids", "worth"])

    kind = docs.schema[key].dataType.simpleString()
    read = spread(docs.select(F.col(key), *(c.alias(f"_{i}") for i, c in enumerate(fields.values()))))
    rows = cut(read.mapInArrow(work, f"{key} {kind}, ids array<int>, worth array<float>"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("hits")).first()
    if max(whole["n"], whole["hits"] or 0) > HELD:
        return None
    keys = whole_of(rows.select(key).toArrow().column(0))
    keys = keys.take(pc.sort_indices(keys))
    counts = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in rows.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        counts[r["id"] + 1] = r["count"]
    starts = np.cumsum(counts)
    values, worth, free = np.empty(starts[-1], dtype=np.int32), np.empty(starts[-1], dtype=np.float32), starts[:-1].copy()
    for t in parts(rows, key, whole["hits"] or 0):
        lists = whole_of(t.column("ids"))
        doc = np.repeat(pc.index_in(whole_of(t.column(key)), keys).to_numpy(), pc.list_value_length(lists).to_numpy())
        ids = lists.flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        # The place of a hit is the next free one of its term.
        at = free[ids] + np.arange(len(ids)) - np.searchsorted(ids, ids)
        values[at], worth[at] = doc[order], whole_of(t.column("worth")).flatten().to_numpy()[order]
        free += np.bincount(ids, minlength=len(free))
    hits = Lists(starts, values, worth)
    by_cue = {c: (np.array([vocabulary[t] for t in g["term"]], dtype=np.int64), int(g["n_terms"].iloc[0])) for c, g in asked.groupby(cue)}
    every = sorted(r[cue] for r in cues.select(cue).distinct().collect())
    none = np.zeros(0, dtype=np.int64), 1
    return Held(keys, every, [by_cue.get(c, none)[0] for c in every], [by_cue.get(c, none)[1] for c in every], list(vocabulary), hits, (kind, cues.schema[cue].dataType.simpleString()))


def each_cue(spark: SparkSession, known: NamedTuple, n: int, work: Callable[[NamedTuple, int], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``work`` gives for the number of every cue, of ``n``; ``known`` is sent to every task."""
    sent = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                if (out := work(sent.value, number)) is not None:
                    yield from (out.slice(at, SLICE) for at in range(0, out.num_rows, SLICE))

    return spark.range(0, n, 1, max(1, min(n, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def complete(held: Held, spark: SparkSession, cue: str, key: str) -> DataFrame:
    """(cue, key, rank) of every document for every cue: by overlap score, those that share nothing last, in order of keys."""

    def work(known: Held, number: int) -> pa.RecordBatch:
        score = np.where(known.hits.sums(known.terms[number], len(known.keys)) > 0, known.units(number), -1)
        rank = np.empty(len(known.keys), dtype=np.int64)
        rank[np.argsort(-score, kind="stable")] = np.arange(1, len(rank) + 1)
        return pa.RecordBatch.from_arrays([pa.array([known.cues[number]]).take(pa.array(np.zeros(len(rank), dtype=np.int64))), known.keys, pa.array(rank)], [cue, key, "rank"])

    return each_cue(spark, held, len(held.cues), work, f"{cue} {held.kinds[1]}, {key} {held.kinds[0]}, rank long")


class Scorer(NamedTuple):
    """What ``activation.activate`` reads, by place of the document: the terms learned for it, amounts of a cue by its
    number, links by their end, and what its use says."""

    held: Held
    damp: np.ndarray
    gone: np.ndarray
    learned: Lists
    learned_weight: np.ndarray
    near: Lists
    links: Lists
    factor: np.ndarray
    title: pa.Array | None = None
    facets: Lists | None = None
    by_facet: Lists | None = None


def scorer(held: Held, tests: DataFrame, gone: DataFrame, near: DataFrame, learned: DataFrame, flow: DataFrame, state: DataFrame, goals: DataFrame, query: str) -> Scorer | None:
    """From tests (node), gone (node), near (query, node, amount), learned (node, term, w), flow (src, dst, share), state
    (node, strength, streak), goals (node, goal); None if that is too much to be sent."""
    near, flow = cut(near), cut(flow)
    words = learned.sparkSession.createDataFrame(list(enumerate(held.vocabulary)) or [(0, "")], "id int, term string")
    learned = cut(learned.distinct().join(F.broadcast(words), "term").groupBy("node").agg(F.collect_list("id").alias("ids"), F.max("w").alias("w")))
    links, amounts = flow.count(), near.count()
    if max(links, amounts, learned.agg(F.sum(F.size("ids"))).first()[0] or 0) > HELD:
        return None
    n = len(held.keys)

    def marked(df: DataFrame) -> np.ndarray:
        out = np.zeros(n, dtype=bool)
        at = held.place(df.select("node").distinct().toArrow().column(0))
        out[at[at >= 0]] = True
        return out

    def valued(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
        t = df.select("node", F.coalesce(column, F.lit(0)).cast("double").alias(column)).toArrow()
        at, values = held.place(t.column(0)), t.column(1).to_numpy()
        return at[at >= 0], values[at >= 0]

    t = learned.toArrow()
    at, weight = held.place(t.column("node")), np.zeros(n)
    weight[at[at >= 0]] = t.column("w").to_numpy()[at >= 0]
    ids = whole_of(t.column("ids"))
    doc, term = np.repeat(at, pc.list_value_length(ids).to_numpy()), ids.flatten().to_numpy()
    taught = Lists.of(term[doc >= 0], doc[doc >= 0], len(held.vocabulary))
    numbers, at, worth = [], [], []
    for t in parts(near.select(query, "node", "amount"), "node", amounts):
        numbers.append(pc.fill_null(pc.index_in(whole_of(t.column(query)), pa.array(held.cues, t.schema.field(query).type)), -1).to_numpy())
        at.append(held.place(t.column("node")))
        worth.append(t.column("amount").to_numpy())
    number, at, worth = map(np.concatenate, (numbers, at, worth))
    known = (number >= 0) & (at >= 0)
    close = Lists.of(number[known], at[known], len(held.cues), worth[known])
    src, dst, worth = [], [], []
    for t in parts(flow.select("src", "dst", "share"), "src", links, PART // 4):
        src.append(held.place(t.column("src")).astype(np.int32))
        dst.append(held.place(t.column("dst")).astype(np.int32))
        worth.append(t.column("share").to_numpy())
    src, dst, worth = map(np.concatenate, (src, dst, worth))
    by_name = np.argsort(src, kind="stable")
    src, dst, worth = src[by_name], dst[by_name], worth[by_name]
    known = (src >= 0) & (dst >= 0)
    flows = Lists.of(dst[known], src[known], n, worth[known])
    strength, goal, wasted = np.zeros(n), np.zeros(n), np.zeros(n)
    for out, df, column in ((strength, state, "strength"), (goal, goals, "goal"), (wasted, state, "streak")):
        at, values = valued(df, column)
        np.maximum.at(out, at, values)
    factor = activation.STRENGTH_LOW + activation.STRENGTH_SPAN * np.minimum(1.0, strength)
    factor = factor * (1 + activation.GOAL_SPAN * np.minimum(1.0, goal)) * np.where(wasted >= activation.WASTE_RUN, activation.WASTE_DAMP, 1.0)
    return Scorer(held, np.where(marked(tests), 1, 2), marked(gone), taught, weight, close, flows, factor)


def with_facets(s: Scorer, notes: DataFrame) -> Scorer:
    """The same with what ``recall.cover_select`` reads: notes (node, title, facets)."""
    t = notes.select("node", "title", "facets").toArrow()
    at = pc.index_in(s.held.keys, whole_of(t.column("node")))
    title, facets = whole_of(t.column("title")).take(at), whole_of(t.column("facets")).take(at)
    counts = pc.fill_null(pc.list_value_length(facets), 0).to_numpy()
    flat = facets.flatten().dictionary_encode("encode").indices.to_numpy()
    doc = np.repeat(np.arange(len(counts)), counts)
    return s._replace(title=title, facets=Lists.of(doc, flat, len(counts)), by_facet=Lists.of(flat, doc, int(flat.max(initial=-1)) + 1))


class _Scored(NamedTuple):
    places: np.ndarray
    score: np.ndarray
    words: np.ndarray
    walk: np.ndarray
    frontiers: list[np.ndarray]
    source: np.ndarray


def _score(s: Scorer, number: int) -> _Scored:
    """The cue's score of each document in millionths, -1 without one, as ``activation.activate`` has it."""
    held, n = s.held, len(s.held.keys)
    terms = held.terms[number]
    words = held.units(number) * s.damp / blocks.UNIT
    top = float(words[~s.gone].max(initial=0.0))
    cap = top * graph.ORPHAN_CAP if top > 0 else np.inf
    met = s.learned.sums(np.unique(terms), n)
    taught = np.where(met >= activation.ASSOCIATION_OVERLAP, activation.ASSOCIATION_WEIGHT * s.learned_weight * np.minimum(1.0, met / activation.ASSOCIATION_FULL), 0.0)
    d = words + (np.minimum(s.near.sums(np.array([number]), n), cap) + np.minimum(taught, cap))
    ends = np.repeat(np.arange(n, dtype=np.int32), np.diff(s.links.starts))
    frontier, walk, frontiers = d, np.zeros(n), []
    for _ in range(graph.STEPS):
        frontiers.append(frontier)
        passed = np.where(frontier > 1e-9, frontier, 0.0)[s.links.values] * graph.DAMPING * s.links.worth
        some = passed > 1e-9
        frontier = np.bincount(ends[some], passed[some], n).astype(float)
        walk += frontier
    with np.errstate(divide="ignore", invalid="ignore"):
        gained = d * (1 + np.where(walk > 0, graph.WALK_GAIN_CAP * walk / (walk + d), 0.0))
    rel = np.where(words > 0, gained, np.minimum(d + walk, cap) if top > 0 else np.where(d > 0, d + walk, 0.0))
    found = np.flatnonzero((words > 0) | (d > 0) | ((top > 0) & (walk > 0)))
    return _Scored(found, blocks.units(rel[found] * s.factor[found]), words, walk, frontiers, ends)


def _carrier(s: Scorer, scored: _Scored, place: int) -> tuple[int | None, int | None]:
    """Whence the largest share of the walk to a document came, and in which step: the earliest and first of equal ones."""
    at = slice(s.links.starts[place], s.links.starts[place + 1])
    best = None
    for hop, frontier in enumerate(scored.frontiers, 1):
        for src, share in zip(s.links.values[at].tolist(), s.links.worth[at].tolist()):
            amount = float(frontier[src]) * graph.DAMPING * share
            if frontier[src] > 1e-9 and amount > 1e-9 and (best is None or (-amount, hop, src) < best):
                best = -amount, hop, src
    return (best[2], best[1]) if best else (None, None)


def _batch(s: Scorer, number: int, query: str, places: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    cue = pa.array([s.held.cues[number]]).take(pa.array(np.zeros(len(places), dtype=np.int64)))
    return pa.RecordBatch.from_arrays([cue, s.held.keys.take(pa.array(places)), *columns.values()], [query, "node", *columns])


def activated(s: Scorer, spark: SparkSession, query: str) -> DataFrame:
    """(query, node, score) of all documents that a cue reaches."""

    def work(known: Scorer, number: int) -> pa.RecordBatch:
        x = _score(known, number)
        return _batch(known, number, query, x.places, score=pa.array(x.score / 1e6))

    return each_cue(spark, s, len(s.held.cues), work, f"{query} {s.held.kinds[1]}, node {s.held.kinds[0]}, score double")


def _order(s: Scorer, x: _Scored) -> np.ndarray:
    """By place of the document: smaller for a better current one, the largest number for what may not be chosen."""
    out = np.full(len(s.held.keys), np.iinfo(np.int64).max)
    some = (x.score > 0) & ~s.gone[x.places]
    places = x.places[some]
    out[places] = -x.score[some] * (len(out) + 1) + places
    return out


def _first(order: np.ndarray, k: int) -> np.ndarray:
    some = np.argpartition(order, k)[:k] if len(order) > k else np.arange(len(order))
    some = some[order[some] < np.iinfo(np.int64).max]
    return some[np.argsort(order[some])]


def _covering(s: Scorer, order: np.ndarray, k: int) -> np.ndarray:
    """The best document of each facet and of the first titles: all that ``recall.cover_select`` can choose."""
    most = np.iinfo(np.int64).max
    held = [order[s.by_facet.values[at]].min(initial=most) for at in s.by_facet.slices(np.arange(len(s.by_facet.starts) - 1))]
    places = {int(v % (len(order) + 1)) for v in held if v < most}
    take = 20 * k
    while True:
        best, titles = _first(order, take), {}
        for place in best.tolist():
            titles.setdefault((s.title[place].as_py() or "").strip().lower(), place)
        if len(titles) >= 2 * k or len(best) < take:
            break
        take *= 4
    places |= set(list(titles.values())[: 2 * k])
    found = np.array(sorted(places), dtype=np.int64)
    return found[np.argsort(order[found])] if len(found) else found


def best(s: Scorer, spark: SparkSession, query: str, k: int, cover: bool = False) -> DataFrame:
    """(query, node, score, rank, words, walk, carrier, hop) of the ``k`` best current documents of each cue; with ``cover``
    of those that ``recall.cover_select`` chooses, in its order."""

    def work(known: Scorer, number: int) -> pa.RecordBatch | None:
        x = _score(known, number)
        order = _order(known, x)
        if cover:
            places = _covering(known, order, k)
            rows = pd.DataFrame({"title": [known.title[int(p)].as_py() for p in places], "facets": [known.facets.values[at].tolist() for at in known.facets.slices(places)]})
            places = places[recall._choose(rows, k)] if len(places) else places
        else:
            places = _first(order, k)
        if not len(places):
            return None
        score = np.zeros(len(known.held.keys), dtype=np.int64)
        score[x.places] = x.score
        told = [_carrier(known, x, p) for p in places.tolist()]
        keys = pa.array([None if c is None else known.held.keys[c].as_py() for c, _ in told], known.held.keys.type)
        columns = {"score": pa.array(score[places] / 1e6), "rank": pa.array(np.arange(1, len(places) + 1)), "words": pa.array(x.words[places]), "walk": pa.array(x.walk[places]), "carrier": keys, "hop": pa.array([h for _, h in told], pa.int32())}
        return _batch(known, number, query, places, **columns)

    return each_cue(spark, s, len(s.held.cues), work, f"{query} {s.held.kinds[1]}, node {s.held.kinds[0]}, score double, rank long, words double, walk double, carrier {s.held.kinds[0]}, hop int")
