"""File dependencies: imports by probes and module aliases, symbol references by their owner, walks over both.

Sources are long tables within a ``scope`` (a repository): no step compares files with files. Names meet their
owners by equality, and how many owners a name has is counted before anything is paired, so a name that very
many files define costs one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import blocks, graph, held
from quillmesh.session import cut, small

# What each relation is worth on an edge, and what it keeps where a name has several owners.
RELATION_WEIGHTS = {"imports": 2.0, "calls": 2.0, "implements": 1.5, "inherits": 1.5, "references": 1.0}
AMBIGUOUS_SHARE, OTHER_WEIGHT = 0.25, 0.5
# Folders at the root that a module's name may leave out, and files that stand for their folder.
ROOTS, FOLDER_FILES = ("app", "lib", "pkg", "python", "src"), ("__init__", "index", "mod")
DEPTH, DECAY, NEIGHBOURS = 2, 0.6, 50
#: Places to which a walk's scores are rounded.
PLACES = 9
SELF, COUNTERPART, NEIGHBOUR = 100.0, 50.0, 1.0


def module_names(path: Column) -> Column:
    """The names by which a file can be imported: its path, with dots, its last part, and without a root folder."""
    parts = F.split(F.regexp_replace(T.clean_path(path), r"(?<=[^/])\.[^./]*$", ""), "/")
    last = F.element_at(parts, -1)
    kept = F.when(last.isin(*FOLDER_FILES), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    inner = F.when(F.get(kept, F.lit(0)).isin(*ROOTS), F.slice(kept, 2, F.size(kept))).otherwise(F.array().cast("array<string>"))
    names = F.array(F.array_join(kept, "/"), F.array_join(kept, "."), F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("")), F.array_join(inner, "/"), F.array_join(inner, "."))
    return F.filter(F.array_distinct(names), lambda n: n != "")


def tails(name: Column) -> Column:
    """What follows each dot or slash of a name, if anything does."""
    parts = F.split(name, "[./]")
    before = lambda i: F.length(F.array_join(F.slice(parts, 1, i), ".")) + 1
    inner = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(inner, lambda i: F.substring(name, before(i) + 1, F.length(name))), lambda t: t != "")


def import_probes(path: Column, imported: Column) -> Column:
    """The names under which an import is looked for, in order.

    A Python import with leading dots is known by what follows them, after its own package's name where a package
    file imports from itself; other relative imports are paths from the importing file's folder.
    """
    value = F.regexp_replace(F.trim(imported), "^['\"]+|['\"]+$", "")
    dotted, python = value.startswith("."), F.endswith(path, F.lit(".py"))
    rest, level = F.regexp_replace(value, r"^\.+", ""), F.length(F.regexp_extract(value, r"^(\.*)", 1))
    package = F.element_at(F.split(T.directory(path), "/"), -1)
    absolute = F.when(~dotted, value).when(F.endswith(path, F.lit("/__init__.py")) & (level == 1), F.concat_ws(".", package, F.nullif(rest, F.lit("")))).otherwise(rest)
    joined = T.normal_path(F.concat_ws("/", F.nullif(T.directory(path), F.lit("")), value))
    normal = F.replace(F.replace(value, F.lit("::"), F.lit(".")), F.lit("/"), F.lit("."))
    own = F.when(dotted & ~python, F.array(joined, F.replace(joined, F.lit("/"), F.lit(".")))).when(python, F.array(absolute, F.replace(absolute, F.lit("."), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(own, F.array(value, normal, F.substring_index(normal, ".", -1)))), lambda p: p != "")


def _owners(names: DataFrame, limit: int) -> DataFrame:
    """(scope, name, ..., owners, files): how many files a name has, and which if they are at most ``limit``."""
    keys = [c for c in names.columns if c != "file"]
    once = names.distinct()
    counted = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("owners"), F.min("file").alias("_one"))
    if limit == 1:
        return counted.withColumn("files", F.when(F.col("owners") == 1, F.array("_one"))).drop("_one")
    few = counted.where(f"owners <= {limit}").select(*keys)
    lists = once.join(few, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("file")).alias("files"))  # at most `limit` each
    return counted.drop("_one").join(lists, keys, "left")


def _ending(name: Column) -> Column:
    """What follows the last dot or slash of a name: names that are equal, or tails of one name, have it in common."""
    return F.regexp_extract(name, r"([^./]*)\z", 1)


def _plain(value: Column) -> Column:
    """Whether all names under which an import is looked for end as it does itself."""
    return F.coalesce(value.rlike(r"^[\w./-]*[\w-]\z"), F.lit(False))


def _asked_near(files: DataFrame, asked: DataFrame, near: DataFrame) -> DataFrame:
    """The imports (scope, file, path, at, symbol) of the files of ``near`` (file), and those that may lead to one of them."""
    here = small(near.select("file").distinct())
    ends = small(files.join(here, "file", "left_semi").select("scope", F.explode(module_names(F.col("path"))).alias("name")).select("scope", _ending(F.col("name")).alias("_end")).distinct())
    others = asked.join(here, "file", "left_anti").withColumn("_end", _ending(F.col("symbol")))
    met = others.where(_plain(F.col("symbol"))).join(ends, ["scope", "_end"], "left_semi")
    return asked.join(here, "file", "left_semi").unionByName(met.select(*asked.columns)).unionByName(others.where(~_plain(F.col("symbol"))).select(*asked.columns))


def import_edges(files: DataFrame, limit: int = 1, per_file: int | None = 100, near: DataFrame | None = None) -> DataFrame:
    """(scope, src, dst, relation, symbol) of files (scope, file, path, imports): each import's first probe that names
    anything, as a whole name or as the end of one, if at most ``limit`` files have that name.

    Null and empty imports lead nowhere, nor does a file's import of itself. With a limit above 1 a file keeps its
    first ``per_file`` edges in order of its imports (None: all); several owners make the relation ambiguous. With
    ``near`` (file) only the edges from and to these files are looked for, among all files.
    """
    asked = files.select("scope", "file", "path", F.posexplode("imports").alias("at", "symbol")).where(F.length(F.trim("symbol")) > 0)
    if near is not None:
        if limit > 1 and per_file:
            raise ValueError("the first edges of a file are not told near others")
        asked = cut(_asked_near(files, asked, near))
    probes = asked.select("scope", "file", "at", "symbol", F.posexplode(import_probes(F.col("path"), F.col("symbol"))).alias("n", "name"))
    places = files.select("scope", "file", "path")
    if near is not None:
        names = small(probes.select("scope", "name").distinct())
        ends = small(names.select("scope", _ending(F.col("name")).alias("_end")).distinct())
        last = F.regexp_extract(F.regexp_replace(T.clean_path(F.col("path")), r"(?<=[^/])\.[^./]*$", ""), r"([^/]*)\z", 1)
        folder = F.element_at(F.split(T.directory(T.clean_path(F.col("path"))), "/"), -1)
        places = places.withColumn("_end", _ending(F.when(last.isin(*FOLDER_FILES), folder).otherwise(last))).join(ends, ["scope", "_end"], "left_semi")
    named = places.select("scope", "file", F.explode(module_names(F.col("path"))).alias("name"))
    whole = named.withColumn("part", F.lit(0))
    tailed = named.select("scope", "file", F.explode(tails(F.col("name"))).alias("name")).withColumn("part", F.lit(1))
    every = whole.unionByName(tailed).select("scope", "name", "part", "file")
    owners = _owners(every if near is None else every.join(names, ["scope", "name"], "left_semi"), limit)
    met = probes.join(owners if near is None else small(owners), ["scope", "name"])
    first = met.groupBy("scope", "file", "at", "symbol").agg(F.min_by(F.struct("owners", "files"), F.struct("n", "part")).alias("o"))
    edges = first.where(F.col("o.owners") <= limit).select("scope", F.col("file").alias("src"), "at", "symbol", F.col("o.owners").alias("owners"), F.explode("o.files").alias("dst")).where("src <> dst")
    if near is not None:
        here = small(near.select("file").distinct()).withColumn("_here", F.lit(True))
        for end in ("src", "dst"):
            edges = edges.join(here.select(F.col("file").alias(end), F.col("_here").alias(f"_{end}")), end, "left")
        edges = edges.where("_src OR _dst")
    elif limit > 1 and per_file:
        edges = edges.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("at", "dst"))).where(F.col("_r") <= per_file)
    relation = F.when(F.col("owners") == 1, "imports").otherwise("imports_ambiguous")
    return edges.select("scope", "src", "dst", relation.alias("relation"), "symbol").distinct()


def symbol_edges(references: DataFrame, definitions: DataFrame, limit: int = 1, per_file: int | None = 100) -> DataFrame:
    """(scope, src, dst, relation, symbol): references (scope, src, at, relation, symbol) to symbols (scope, symbol, file)
    that at most ``limit`` files define.

    A plain reference to a symbol counts only where the file has no typed one to it. A file keeps its first
    ``per_file`` edges, typed ones first, in order of place (None: all).
    """
    owners = _owners(definitions.select("scope", "symbol", "file"), limit).where(F.col("files").isNotNull())
    typed = F.col("relation") != "references"
    once = references.groupBy("scope", "src", "relation", "symbol").agg(F.min("at").alias("at"))
    told = once.where(typed).select("scope", "src", "symbol").distinct()
    asked = once.where(typed).unionByName(once.where(~typed).join(told, ["scope", "src", "symbol"], "left_anti").select(*once.columns))
    edges = asked.join(owners, ["scope", "symbol"]).select("scope", "src", "at", "relation", "symbol", "owners", F.explode("files").alias("dst")).where("src <> dst")
    if per_file:
        order = Window.partitionBy("src").orderBy((~typed).cast("int"), "at", "symbol", "dst")
        edges = edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_file)
    relation = F.when(F.col("owners") == 1, F.col("relation")).otherwise(F.concat("relation", F.lit("_ambiguous")))
    return edges.select("scope", "src", "dst", relation.alias("relation"), "symbol").distinct()


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): each directed pair once, at the weight of its strongest relation."""
    weight: Column = F.lit(OTHER_WEIGHT)
    for name, w in RELATION_WEIGHTS.items():
        weight = F.when(F.col("relation") == name, w).when(F.col("relation") == f"{name}_ambiguous", w * AMBIGUOUS_SHARE).otherwise(weight)
    return edges.groupBy("src", "dst").agg(F.max(weight).alias("weight"))


def dependency_ranking(pairs: DataFrame | Callable[[DataFrame], DataFrame], anchors: DataFrame, query: str, direction: str = "both", depth: int = DEPTH, decay: float = DECAY) -> DataFrame:
    """(query, node, score): what reaches files from anchors (query, node) over directed pairs (src, dst, weight).

    ``dependencies`` follows edges, ``dependents`` goes against them, ``both`` adds the two. Step i passes on
    decay ** i of what came before; the anchors themselves are left out. ``pairs`` may be a function of files (file) that
    gives the pairs from and to them. Only the pairs of files that the walk passes through are weighed, and up to ``held.HELD`` of them are sent to every task, which walks for one query after the
    other: a file that very many use joins its users with every query that reaches it, and that product is neither
    written nor shuffled.
    """
    ways = {"dependencies": [_same], "dependents": [_turned], "both": [_same, _turned]}
    if direction not in ways:
        raise ValueError(f"no direction: {direction}")
    seeds = cut(anchors.select(query, "node").distinct())
    flow, factors = _near(pairs if callable(pairs) else lambda _: pairs, ways[direction], seeds, depth), [decay ** (i + 1) for i in range(depth)]
    if known := _reach(flow, seeds, query, factors):
        return _walked(known, seeds, query)
    reached = graph.walk(seeds.withColumn("amount", F.lit(1.0)), flow, factors=factors, query=query)
    return reached.join(seeds, [query, "node"], "left_anti").select(query, "node", F.round("walk", PLACES).alias("score"))


def _same(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst", "weight")


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def _near(pairs: Callable[[DataFrame], DataFrame], ways: list[Callable[[DataFrame], DataFrame]], seeds: DataFrame, depth: int) -> DataFrame:
    """(src, dst, share) of the files that a walk of so many steps from ``seeds`` (node) passes through."""
    at, flow = seeds.select(F.col("node").alias("src")).distinct(), None
    for _ in range(depth):
        here = small(at)
        found = pairs(here.select(F.col("src").alias("file")))
        own = cut(reduce(DataFrame.unionByName, (way(found).join(here, "src", "left_semi") for way in ways)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
        step = cut(graph.shares(own))
        flow = step if flow is None else flow.unionByName(step)
        at = step.select(F.col("dst").alias("src")).distinct().join(flow.select("src").distinct(), "src", "left_anti")
    return flow


class _Reach(NamedTuple):
    """Files in order of their names, what flows out of each by its place, and the anchors' places of each query."""

    keys: pa.Array
    flow: held.Lists
    queries: pa.Array
    anchors: held.Lists
    factors: list[float]


def _reach(flow: DataFrame, seeds: DataFrame, query: str, factors: list[float]) -> _Reach | None:
    """From (src, dst, share) and seeds (query, node); None if that is too much to be sent."""
    edges, asked = flow.count(), seeds.count()
    if max(edges, asked) > held.HELD:
        return None
    ends = cut(flow.select("src").unionByName(flow.select(F.col("dst").alias("src"))).distinct())
    keys = pa.chunked_array([c for t in held.parts(ends, "src", edges) for c in t.column(0).chunks], pa.string()).combine_chunks()
    keys = keys.take(pc.sort_indices(keys))
    place = lambda column: pc.fill_null(pc.index_in(held.whole_of(column), keys), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    src, dst, share = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0)]
    for t in held.parts(flow.select("src", "dst", "share"), "src", edges, held.PART // 4):
        for out, values in ((src, place(t.column("src"))), (dst, place(t.column("dst"))), (share, t.column("share").to_numpy())):
            out.append(values)
    t = seeds.select(query, "node").toArrow()
    coded = held.whole_of(t.column(query)).dictionary_encode()
    at, number = place(t.column("node")), coded.indices.to_numpy()
    some = at >= 0
    links = held.Lists.of(np.concatenate(src), np.concatenate(dst), len(keys), np.concatenate(share))
    return _Reach(keys, links, coded.dictionary, held.Lists.of(number[some], at[some], len(coded.dictionary)), factors)


def _reached(known: _Reach, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores): what reaches each file from the anchors of a query, without these, as ``graph.walk`` has it."""
    own = known.anchors.values[known.anchors.slices([number])[0]]
    nodes, amounts, places, parts = own, np.ones(len(own)), [], []
    for factor in known.factors:
        nodes, amounts = nodes[amounts > graph.LEAST], amounts[amounts > graph.LEAST]
        at = known.flow.slices(nodes)
        if not at:
            break
        ends = np.concatenate([known.flow.values[s] for s in at])
        passed = np.repeat(amounts * factor, [s.stop - s.start for s in at]) * np.concatenate([known.flow.worth[s] for s in at])
        some = passed > graph.LEAST
        nodes, of = np.unique(ends[some], return_inverse=True)
        amounts = np.bincount(of, passed[some], len(nodes))
        places.append(nodes)
        parts.append(amounts)
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    found, of = np.unique(np.concatenate(places), return_inverse=True)
    new = ~np.isin(found, own)
    return found[new], blocks.units(np.bincount(of, np.concatenate(parts), len(found))[new], PLACES) / 10.0**PLACES


def _walked(known: _Reach, seeds: DataFrame, query: str) -> DataFrame:
    """(query, node, score) of all queries, some in a task."""
    spark, kind, n = seeds.sparkSession, seeds.schema[query].dataType.simpleString(), len(known.queries)
    sent, names = spark.sparkContext.broadcast(known), [query, "node", "score"]

    def batch(know: _Reach, numbers: list[int], places: list[np.ndarray], scores: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        number = np.repeat(numbers, [len(p) for p in places])
        place, score = np.concatenate(places), np.concatenate(scores)
        for i in range(0, len(place), held.SLICE):
            s = slice(i, i + held.SLICE)
            yield pa.RecordBatch.from_arrays([know.queries.take(pa.array(number[s])), know.keys.take(pa.array(place[s])), pa.array(score[s])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, numbers, places, scores, rows = sent.value, [], [], [], 0
        for b in batches:
            for number in b.column(0).to_pylist():
                place, score = _reached(know, number)
                numbers.append(number)
                places.append(place)
                scores.append(score)
                rows += len(place)
                if rows >= held.SLICE:
                    yield from batch(know, numbers, places, scores)
                    numbers, places, scores, rows = [], [], [], 0
        if rows:
            yield from batch(know, numbers, places, scores)

    return spark.range(0, n, 1, max(1, min(n, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, f"{query} {kind}, node string, score double")


def symbol_nodes(locations: DataFrame, calls: DataFrame) -> DataFrame:
    """(scope, file, label): a file's symbols: of each line (scope, file, line, label) the most qualified one, and
    whatever calls (scope, file, label, target) from it."""
    depth = F.size(F.split("label", r"::|\."))
    best = locations.where(F.length("label") > 0).groupBy("scope", "file", "line").agg(F.max(F.struct(depth.alias("d"), F.length("label").alias("n"), "label")).alias("b"))
    return best.select("scope", "file", F.col("b.label").alias("label")).unionByName(calls.select("scope", "file", "label")).distinct()


def symbol_ranking(nodes: DataFrame, calls: DataFrame, anchors: DataFrame, query: str, depth: int = DEPTH, cap: int | None = NEIGHBOURS, per_anchor: int = 1) -> DataFrame:
    """(query, file, score, hop): files reached over symbols from ranked anchors (query, file, rank).

    Each anchor starts at the symbol that calls most names, at 1 / rank. A name leads to all symbols that bear it,
    whole or as their last part; a symbol keeps its first ``cap`` neighbours in order (None: all). A symbol is
    visited once, first from its highest caller; hop h multiplies by 1 / (1 + h). A file counts at its best symbol.
    """
    node = F.struct("file", "label")
    known = nodes.select("scope", node.alias("node"), "label")
    targets = calls.select("scope", F.struct("file", "label").alias("at"), "target").distinct()
    called = targets.select("scope", "target").distinct()
    alias = known.select("scope", "node", F.explode(F.array_distinct(F.array("label", F.element_at(F.split("label", r"::|\."), -1)))).alias("target")).join(called, ["scope", "target"], "left_semi").distinct()
    if cap:  # a name's first symbols are enough for every caller, itself included
        alias = alias.withColumn("_r", F.row_number().over(Window.partitionBy("scope", "target").orderBy("node"))).where(F.col("_r") <= cap + 1).drop("_r")
    alias = cut(alias)

    def steps(from_: DataFrame) -> DataFrame:
        """(at, node): the neighbours of the nodes that a walk has come to, not of all."""
        here = targets.join(from_.select(F.col("node").alias("at")).distinct(), "at", "left_semi")
        out = here.join(alias, ["scope", "target"]).where("at <> node").groupBy("at", "node").agg(F.min("target").alias("target"))
        if cap:
            out = out.withColumn("_r", F.row_number().over(Window.partitionBy("at").orderBy("target", "node"))).where(F.col("_r") <= cap)
        return out.select("at", F.col("node").alias("to"))

    # Only the anchors' files are looked at for their busiest symbols.
    own = nodes.join(anchors.select("file").distinct(), "file", "left_semi").select("file", node.alias("at")).distinct()
    degree = targets.join(own.select("at"), "at", "left_semi").groupBy("at").agg(F.count(F.lit(1)).alias("degree"))
    busiest = own.join(degree, "at", "left")
    order = Window.partitionBy("file").orderBy(F.coalesce("degree", F.lit(0)).desc(), "at")
    busiest = busiest.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_anchor).select("file", "at")
    start = anchors.groupBy(query, "file").agg(F.min("rank").alias("rank")).join(busiest, "file")
    seen = cut(start.select(query, F.col("at").alias("node"), (1.0 / F.col("rank")).alias("score"), F.lit(0).alias("hop")))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(steps(frontier), F.col("node") == F.col("at")).select(query, F.col("to").alias("node"), (F.col("score") * (1.0 / (1 + hop))).alias("score"))
        fresh = reached.groupBy(query, "node").agg(F.max("score").alias("score")).join(seen.select(query, "node"), [query, "node"], "left_anti")
        frontier = cut(fresh.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    best = seen.groupBy(query, F.col("node.file").alias("file")).agg(F.max(F.struct("score", (-F.col("hop")).alias("near"))).alias("b"))
    return best.select(query, "file", F.round("b.score", 9).alias("score"), (-F.col("b.near")).cast("long").alias("hop"))


def neighbourhood(files: DataFrame, anchors: DataFrame, query: str) -> DataFrame:
    """(query, file, score, seed_rank): files (scope, file, path) around ranked anchors (query, file, rank): the anchor
    itself at 100 / rank, files of its stem at 50 / rank, files of its folder at 1 / rank; the best counts, at a tie
    that of the earlier anchor. Folder and stem are joins of their own, by equality.
    """
    placed = files.select("scope", "file", T.directory(F.col("path")).alias("folder"), T.stem_name(F.col("path")).alias("stem"))
    seeds = anchors.groupBy(query, "file").agg(F.min("rank").alias("rank")).join(placed, "file")
    worth = lambda w: (F.lit(w) / F.col("rank")).alias("score")
    own = seeds.select(query, "file", "rank", worth(SELF))
    twin = seeds.select(query, "scope", "stem", "rank").join(placed.select("scope", "stem", "file"), ["scope", "stem"]).select(query, "file", "rank", worth(COUNTERPART))
    near = seeds.select(query, "scope", "folder", "rank").join(placed.select("scope", "folder", "file"), ["scope", "folder"]).select(query, "file", "rank", worth(NEIGHBOUR))
    best = own.unionByName(twin).unionByName(near).groupBy(query, "file").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"))).alias("b"))
    return best.select(query, "file", F.round("b.score", 9).alias("score"), (-F.col("b.r")).cast("long").alias("seed_rank"))
