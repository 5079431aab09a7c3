"""Route-specific fusion, providers of dependencies, entity gates and ingest of an inferred layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import fusion

# What each ranking weighs on each route, and how many of which ranking stay in front.
ROUTES: dict[str, tuple[dict[str, float], list[tuple[str, int]]]] = {
    "code": ({"current": 0.25, "repo_map": 1.5, "reranker": 1.5, "semantic": 0.0, "structural": 1.0}, [("reranker", 2), ("repo_map", 1)]),
    "comment": ({"current": 1.0, "repo_map": 1.0, "reranker": 0.0, "semantic": 1.5, "structural": 0.25}, [("semantic", 2)]),
    "ripple": ({"current": 1.12, "repo_map": 1.0, "reranker": 0.0, "semantic": 0.0, "structural": 0.0}, [("current", 1), ("repo_map", 2)]),
    "trace": ({"semantic": 1.0, "directory": 0.75, "repo_map": 0.5, "symbol": 1.5}, []),
    "general": ({}, []),
}
# Bounds of an inferred layer, and what its edges weigh.
CONCEPTS, EDGES, MEMBERS, INFERRED_WEIGHT = 24, 60, 12, 0.5


# Parts that must all be there, parts of which one must be, and the route that then holds, in order.
ROUTE_RULES: tuple[tuple[tuple[str, ...], tuple[str, ...], str], ...] = (
    (("command", "failure_excerpt"), (), "trace"),
    (("anchor_file", "anchor_diff"), (), "ripple"),
    (("review_comment",), ("given_file", "path"), "comment"),
    ((), ("changed_file", "implementation_files"), "code"),
)
# Which way dependencies are walked on a route.
DIRECTIONS = {"trace": "dependencies", "ripple": "dependents", "comment": "both", "code": "both", "general": "both"}


def route_of(parts: Column) -> Column:
    """The route of a query from the names of the parts it has (an array): the first rule that holds, else ``general``."""
    names = lambda wanted: F.array(*map(F.lit, wanted)).cast("array<string>")
    holds = [(F.size(F.array_except(names(every), parts)) == 0) & (F.arrays_overlap(names(some), parts) if some else F.lit(True)) for every, some, _ in ROUTE_RULES]
    return F.coalesce(*(F.when(rule, F.lit(route)) for rule, (_, _, route) in zip(holds, ROUTE_RULES)), F.lit("general"))


def anchors_of(queries: DataFrame, query: str, parts: list[str], text: str, paths: DataFrame, path: str) -> DataFrame:
    """(query, anchor, n): the files a query is about: those its path columns name, in order, then those its text mentions.

    A mentioned path is found by its words between blanks, quotes and brackets, so texts and paths meet by
    equality. Each anchor once, at its first place.
    """
    named = queries.select(query, F.posexplode(F.array(*parts)).alias("n", "anchor")).where(F.length("anchor") > 0)
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\s\"'`()\[\]{}<>,;]+[^\s\"'`()\[\]{}<>,;.:!?]"), F.lit(0))
    said = queries.select(query, F.explode(F.array_distinct(words)).alias("_w"))
    found = said.join(paths.select(F.col(path).alias("anchor"), F.lower(path).alias("_w")).distinct(), "_w").select(query, F.lit(len(parts)).alias("n"), "anchor")
    first = named.select(query, "n", "anchor").unionByName(found).groupBy(query, "anchor").agg(F.min("n").alias("n"))
    return first.select(query, "anchor", F.row_number().over(Window.partitionBy(query).orderBy("n", "anchor")).cast("long").alias("n"))


def routed(rankings: DataFrame, query: str, key: str, route: str, unique: bool = False) -> DataFrame:
    """(query, key, rank) of (query, ranking, key, rank) under a route's weights; unknown rankings weigh nothing there.

    Rankings of no weight still bring their keys, after all others. ``unique`` says that no ranking repeats a key.
    """
    weights, front = ROUTES[route]
    if not weights:
        return fusion.fused(rankings, query, key, unique=unique).select(query, key, "rank")
    known = rankings.where(F.col("ranking").isin(*weights))
    if not front:
        return fusion.fused(known, query, key, weights, unique=unique).select(query, key, "rank")
    placed: DataFrame | None = None
    offset = 0
    for name, keep in front:
        source = known.where(F.col("ranking") == name).select(query, key, "rank")
        if placed is not None:
            source = source.join(placed.select(query, key), [query, key], "left_anti")
        own = source.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy("rank", key))).where(F.col("pos") <= keep).select(query, key, (F.col("pos") + offset).alias("pos"))
        placed = own if placed is None else placed.unionByName(own)
        offset += keep
    rest = fusion.fused(known, query, key, weights, unique=unique)
    joined = rest.join(placed, [query, key], "left")
    order = Window.partitionBy(query).orderBy(F.coalesce("pos", F.lit(2**31)), F.col("rank"))
    return joined.select(query, key, F.row_number().over(order).alias("rank"))


def provided(internal: DataFrame, external: DataFrame, extensions: list[str], known: DataFrame) -> DataFrame:
    """(src, dst, provider): a provider's edges replace our own for sources of its extensions, where both ends are
    known paths; a provider without edges for an extension changes nothing."""
    ext = F.lower(F.regexp_extract("src", r"\.([A-Za-z0-9]+)$", 1))
    theirs = external.where(ext.isin(*extensions)).join(known.select(F.col("path").alias("src")), "src", "left_semi").join(known.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    covered = theirs.select(ext.alias("ext")).distinct()
    ours = internal.select("src", "dst", ext.alias("ext")).join(covered, "ext", "left_anti").select("src", "dst")
    return ours.withColumn("provider", F.lit("internal")).unionByName(theirs.withColumn("provider", F.lit("external")))


# Words of names that tell no one apart.
GENERIC = ("capital", "company", "corp", "corporation", "fund", "group", "holdings", "inc", "labs", "limited", "llc", "ltd", "meeting", "partners", "ventures")


def eligible_entities(notes: DataFrame, cues: DataFrame, cue: str, text: str, types: tuple[str, ...] = (), component: int = 4) -> DataFrame:
    """(cue, path): notes that a cue certainly names: their whole title, of two words or more, stands in it and no other
    note has it; or a word of their title does, of ``component`` letters or more, that only one note's title has, is
    no generic word, and has no capitalised neighbour in the cue that is not of that title.

    ``types`` restricts the notes by ``note_type``. A cue's word runs meet titles by equality, so neither side is
    scanned for the other.
    """
    split = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    known = notes.where(F.col("note_type").isin(*types)) if types else notes
    titled = known.select("path", split(F.lower("title")).alias("w")).where("size(w) >= 1").select("path", "w", F.array_join("w", " ").alias("identity"), F.size("w").alias("n"))
    owners = titled.where("n >= 2").groupBy("identity", "n").agg(F.min("path").alias("path"), F.max("path").alias("other")).where("path = other").drop("other")
    lengths = owners.agg(F.max("n").alias("most"))
    spoken = cues.select(cue, split(F.col(text)).alias("o")).withColumn("w", F.transform("o", F.lower))
    starts = spoken.crossJoin(F.broadcast(lengths)).select(cue, "w", "most", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))).alias("i"))
    runs = starts.select(cue, F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.coalesce("most", F.lit(2)))), lambda k: F.struct(F.array_join(F.slice("w", F.col("i"), k), " ").alias("identity"), F.size(F.slice("w", F.col("i"), k)).alias("n"), k.alias("k")))).alias("r"))
    whole = runs.where("r.n = r.k").select(cue, "r.identity").distinct().join(owners, "identity").select(cue, "path")
    parts = titled.select("path", "w", F.explode(F.array_distinct("w")).alias("word")).where((F.length("word") >= component) & ~F.col("word").isin(*GENERIC))
    alone = parts.groupBy("word").agg(F.min(F.struct("path", "w")).alias("p"), F.countDistinct("path").alias("n")).where("n = 1").select("word", "p.path", F.col("p.w").alias("own"))
    said = spoken.select(cue, "o", F.posexplode("w").alias("i", "word"))
    said = said.select(cue, "word", F.filter(F.array(F.get("o", F.col("i") - 1), F.get("o", F.col("i") + 1)), lambda x: x.isNotNull() & x.rlike(r"^\p{Lu}")).alias("near"))
    single = said.join(alone, "word").where(F.size(F.array_except(F.transform("near", F.lower), "own")) == 0).select(cue, "path")
    return whole.unionByName(single).distinct()


def inferred_layer(replies: DataFrame, handles: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, target, relation, weight, provenance) of JSON replies (reply) with handles resolved (handle, id).

    At most EDGES edges in order; unknown handles, loops and edges that exist already are left out.
    """
    schema = "concepts array<struct<label: string, members: array<string>>>, edges array<struct<source: string, target: string, relation: string>>"
    parsed = replies.select(F.from_json("reply", schema).alias("r")).where("r IS NOT NULL")
    edges = parsed.select(F.posexplode(F.slice("r.edges", 1, EDGES)).alias("n", "e")).select("n", "e.source", "e.target", T.relation_token(F.col("e.relation")).alias("relation"))
    concepts = parsed.select(F.explode(F.slice("r.concepts", 1, CONCEPTS)).alias("c")).select(F.concat(F.lit("concept:"), T.slug(F.col("c.label"))).alias("source"), F.explode(F.slice("c.members", 1, MEMBERS)).alias("h"))
    h = handles.select("handle", "id")
    direct = edges.join(h.withColumnRenamed("handle", "source").withColumnRenamed("id", "s"), "source").join(h.withColumnRenamed("handle", "target").withColumnRenamed("id", "t"), "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "relation")
    member = concepts.join(h.withColumnRenamed("handle", "h"), "h").select("source", F.col("id").alias("target"), F.lit("groups").alias("relation"))
    new = direct.unionByName(member).where("source <> target").distinct().join(existing.select("source", "target"), ["source", "target"], "left_anti")
    return new.withColumn("weight", F.lit(INFERRED_WEIGHT)).withColumn("provenance", F.lit("inferred"))


def overlapping_claims(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """(owner, path, mine): claimed paths that mean a changed file: equal, or a suffix of it at a folder boundary.

    Each path is taken with its suffixes, so the two sides meet by equality instead of all against all.
    """
    norm = lambda c: F.regexp_replace(F.trim(c), "^/+|/+$", "")

    def suffixes(df: DataFrame, col: str) -> DataFrame:
        p = F.split(norm(F.col(col)), "/")
        return df.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/"))).alias("_s"))

    whole_claims = claims.withColumn("_s", norm(F.col("path")))
    whole_changed = changed.withColumn("_s", norm(F.col("mine")))
    with_folder = lambda df: df.where(F.col("_s").contains("/"))
    a = suffixes(claims, "path").join(with_folder(whole_changed), "_s")
    b = with_folder(whole_claims).join(suffixes(changed, "mine"), "_s")
    c = whole_claims.join(whole_changed, "_s")
    return a.select("owner", "path", "mine").unionByName(b.select("owner", "path", "mine")).unionByName(c.select("owner", "path", "mine")).where("path <> '' AND mine <> ''").distinct()
