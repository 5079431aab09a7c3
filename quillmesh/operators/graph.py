"""Links, merged graphs and damped walks as joins over edge tables.

A walk's number of steps is fixed, so it is unrolled: each step is one join with the adjacency and one
combinable aggregate. Nothing is collected, and no step looks at a node's neighbours in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.session import cut

# What a stated confidence is worth on an edge.
CONFIDENCE = {"extracted": 1.0, "inferred": 0.5, "ambiguous": 0.2}
OTHER_CONFIDENCE = 0.5
BASE_PRIOR, DAMPING, STEPS = 0.25, 0.5, 3
WALK_GAIN_CAP, ORPHAN_CAP = 0.5, 0.4
#: Amounts of this and less are dropped.
LEAST = 1e-9


def mask_code(body: Column) -> Column:
    """The body without fenced blocks, code spans, HTML comments and verbatim HTML blocks, deleted text and images, in
    which no link counts. Code by indentation alone is not told from the continuation of a list and stays."""
    b = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?ms)^(?:```|~~~)[^\n]*+\n.*?^(?:```|~~~)[ \t]*+$", " ")
    b = F.regexp_replace(F.regexp_replace(b, r"`[^`\n]++`", " "), r"(?s)<!--.*?-->", " ")
    b = F.regexp_replace(b, r"(?is)<(pre|script|style|textarea)\b.*?</(pre|script|style|textarea)>", " ")
    return F.regexp_replace(b, r"~~[^~\n]++~~|!\[\[[^\[\]\n]*+\]\]|!\[[^\[\]\n]*+\]\([^()\n]*+\)", " ")


def wiki_links(notes: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name): each name that a body links to, once."""
    found = F.regexp_extract_all(mask_code(F.col(body)), F.lit(r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]"), F.lit(1))
    return notes.select(key, F.explode(F.array_distinct(F.transform(found, T.normal_name))).alias("name"))


def typed_links(notes: DataFrame, key: str, body: str) -> DataFrame:
    """(key, relation, name, confidence, weight) of list items ``- relation [[name]] (confidence)``; the best weight
    of a (name, relation) stays."""
    pattern = r"(?m)^- ([\w-]+) \[\[([^\[\]|\n]+)\]\](?: \((\w+)\))?[ \t]*$"
    line = F.explode(F.regexp_extract_all(mask_code(F.col(body)), F.lit(pattern), F.lit(0)))
    rows = notes.select(key, line.alias("_l")).select(key, *(F.regexp_extract("_l", pattern, i).alias(a) for i, a in enumerate(("relation", "name", "confidence"), 1)))
    confidence = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("extracted"))
    weight = F.lit(OTHER_CONFIDENCE)
    for word, w in CONFIDENCE.items():
        weight = F.when(F.col("confidence") == word, F.lit(w)).otherwise(weight)
    rows = rows.withColumn("confidence", confidence).withColumn("name", T.normal_name(F.col("name"))).withColumn("weight", weight)
    best = rows.groupBy(key, "relation", "name").agg(F.max(F.struct("weight", "confidence")).alias("b"))
    return best.select(key, "relation", "name", F.col("b.confidence").alias("confidence"), F.col("b.weight").alias("weight"))


_TYPED_LINE = r"(?m)^- [\w-]+ \[\[[^\[\]|\n]+\]\](?: \(\w+\))?[ \t]*$"


def note_links(notes: DataFrame, key: str, body: str) -> DataFrame:
    """(key, wiki, markdown): each link of a body outside typed lines, as it is written: a wiki name or a Markdown target."""
    plain = F.regexp_replace(mask_code(F.col(body)), _TYPED_LINE, " ")
    wiki = F.transform(F.regexp_extract_all(plain, F.lit(r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]"), F.lit(1)), lambda v: F.struct(v.alias("wiki"), F.lit(None).cast("string").alias("markdown")))
    found = F.regexp_extract_all(plain, F.lit(r"(?<!!)\[[^\[\]\n]*\]\(\s*(<[^<>\n]*>|[^()\s<>]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)"), F.lit(1))
    defined = F.regexp_extract_all(plain, F.lit(r"(?m)^ {0,3}\[[^\[\]\n]+\]:[ \t]*(\S+)"), F.lit(1))
    marked = F.transform(F.concat(found, defined), lambda v: F.struct(F.lit(None).cast("string").alias("wiki"), v.alias("markdown")))
    return notes.select(key, F.explode(F.array_distinct(F.concat(wiki, marked))).alias("l")).select(key, "l.wiki", "l.markdown")


def identities(notes: DataFrame, replaced: DataFrame) -> DataFrame:
    """(name, target): the names by which a note can be linked, file name, title and aliases (an array, if there is one).

    A name belongs to the one current note that has it; if none of its notes is current, to the only one; else to
    none. ``replaced`` (path) are the notes that are not current.
    """
    extra = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in notes.columns else F.array().cast("array<string>")
    stem = F.regexp_replace(T.base_name(F.col("path")), r"\.md$", "")
    names = F.filter(F.transform(F.concat(F.array(stem, F.coalesce("title", F.lit(""))), extra), T.normal_name), lambda n: n != "")
    owned = notes.select("path", F.explode(F.array_distinct(names)).alias("name")).distinct().join(replaced.select("path").distinct().withColumn("_r", F.lit(True)), "path", "left")
    current = F.when(F.col("_r").isNull(), F.col("path"))
    counted = owned.groupBy("name").agg(F.count(current).alias("c"), F.min(current).alias("one"), F.count(F.lit(1)).alias("n"), F.min("path").alias("any"))
    return counted.select("name", F.when(F.col("c") == 1, F.col("one")).when((F.col("c") == 0) & (F.col("n") == 1), F.col("any")).alias("target")).where("target IS NOT NULL")


def resolve_links(links: DataFrame, notes: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, target): links (key, wiki, markdown, and what else they have) led to notes: a wiki name is a path, a path
    without ``.md``, or a name with blanks or hyphens, the first that there is; a Markdown target is a path.

    ``names`` come from ``identities``. What leads nowhere or to its own note is dropped. One join for all ways.
    """
    known = notes.select(F.concat(F.lit("/"), "path").alias("_v"), F.col("path").alias("target")).unionByName(names.select(F.concat(F.lit("="), "name").alias("_v"), "target"))
    raw = F.trim("wiki")
    name = T.normal_name(F.col("wiki"))
    ways = F.array(
        F.when(F.col("wiki").isNull(), F.concat(F.lit("/"), T.markdown_target(F.col(key), F.col("markdown")))).otherwise(F.concat(F.lit("/"), raw)),
        F.when(raw.contains("/"), F.concat(F.lit("/"), raw, F.lit(".md"))),
        F.concat(F.lit("="), name),
        F.concat(F.lit("="), F.replace(name, F.lit(" "), F.lit("-"))),
    )
    rest = [c for c in links.columns if c not in ("wiki", "markdown")]
    tried = links.select(*links.columns, F.posexplode(ways).alias("_n", "_v")).where("_v IS NOT NULL").join(known, "_v")
    first = tried.groupBy(*links.columns).agg(F.min_by("target", "_n").alias("target"))
    return first.where(F.col(key) != F.col("target")).select(*rest, "target").distinct()


def resolve(links: DataFrame, identities: DataFrame, key: str) -> DataFrame:
    """(key, target): links whose name belongs to exactly one identity (``identities`` has name and path)."""
    unique = identities.groupBy("name").agg(F.min("path").alias("target"), F.max("path").alias("_last")).where("target = _last").drop("_last")
    return links.join(unique, "name").where(F.col(key) != F.col("target")).select(key, "target").distinct()


def merged(edges: DataFrame) -> DataFrame:
    """(a, b, weight, kind) with a < b: of all edges of a pair the heaviest; an authored one (kind ``link``) wins a tie, then a typed one."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight", "kind")
    best = pairs.groupBy("a", "b").agg(F.max(F.struct("weight", F.when(F.col("kind") == "link", 2).when(F.col("kind") == "typed", 1).otherwise(0).alias("authored"), "kind")).alias("e"))
    return best.select("a", "b", F.col("e.weight").alias("weight"), F.col("e.kind").alias("kind"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """(src, dst, weight) both ways."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def shares(adj: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(src, dst, share): each neighbour's part of what flows out of a node, by weight times prior (node, prior)."""
    w = adj if prior is None else adj.join(prior.withColumnRenamed("node", "dst"), "dst", "left").withColumn("weight", F.col("weight") * F.coalesce("prior", F.lit(BASE_PRIOR)))
    total = w.groupBy("src").agg(F.sum("weight").alias("z")).where("z > 0")
    return w.join(total, "src").select("src", "dst", (F.col("weight") / F.col("z")).alias("share"))


def walk(seeds: DataFrame, flow: DataFrame, steps: int = STEPS, factors: list[float] | None = None, query: str = "query_id", carriers: bool = False) -> DataFrame:
    """(query, node, walk): what reaches each node over all steps from ``seeds`` (query, node, amount).

    Step i passes on ``factors[i]`` of what arrived before it. Amounts of 1e-9 and less are dropped. ``carriers``
    adds carrier and hop: whence the largest single share came, the earliest and first of equal ones.
    """
    factors = factors or [DAMPING] * steps
    flow = cut(flow)
    frontier, reached = seeds.select(query, "node", "amount"), None
    for hop, f in enumerate(factors, 1):
        out = frontier.select(query, "node", "amount").where("amount > 1e-9").join(flow, F.col("node") == F.col("src"))
        out = out.select(query, F.col("dst").alias("node"), (F.col("amount") * f * F.col("share")).alias("amount"), "src").where("amount > 1e-9")
        told = [F.min(F.struct((-F.col("amount")).alias("m"), F.lit(hop).alias("hop"), F.col("src").alias("carrier"))).alias("by")] if carriers else []
        frontier = cut(out.groupBy(query, "node").agg(F.sum("amount").alias("amount"), *told))
        reached = frontier if reached is None else reached.unionByName(frontier)
    if not carriers:
        return reached.groupBy(query, "node").agg(F.sum("amount").alias("walk"))
    return reached.groupBy(query, "node").agg(F.sum("amount").alias("walk"), F.min("by").alias("by")).select(query, "node", "walk", "by.carrier", "by.hop")


def blend(lexical: DataFrame, reached: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, node, score): lexical hits gain at most half from the walk; what only the walk reaches stays below 0.4
    of the query's best lexical score. Rounded to six places."""
    top = lexical.groupBy(query).agg(F.max("amount").alias("top"))
    both = lexical.select(query, "node", F.col("amount").alias("d")).join(reached, [query, "node"], "full").join(top, query, "left").fillna(0.0, ["d", "walk", "top"])
    gained = F.col("d") * (1 + WALK_GAIN_CAP * F.col("walk") / (F.col("walk") + F.col("d")))
    score = F.when((F.col("d") > 0) & (F.col("walk") > 0), gained).when(F.col("d") > 0, F.col("d")).when(F.col("top") > 0, F.least("walk", F.col("top") * ORPHAN_CAP)).otherwise(F.col("walk"))
    return both.select(query, "node", F.round(score, 6).alias("score"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): how often a node ends an edge."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def co_use(touches: DataFrame, session: str, note: str, order: str) -> DataFrame:
    """(a, b, w) with a < b: each touch counts once for every other note that its session had seen before.

    The sessions' first touches are reduced before they are joined, so the work is that of the result's pairs.
    """
    firsts = touches.groupBy(session, note).agg(F.min(order).alias("_first"))
    seen = firsts.select(session, F.col(note).alias("_other"), "_first")
    pairs = touches.select(session, note, order).join(seen, session).where((F.col("_first") < F.col(order)) & (F.col("_other") != F.col(note)))
    return pairs.groupBy(F.least(note, "_other").alias("a"), F.greatest(note, "_other").alias("b")).agg(F.count(F.lit(1)).alias("w"))
