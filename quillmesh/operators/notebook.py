"""Notes as they are written: paths, headers, notes made from a graph, rules as pages, observed files led to notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import graph

# Names that no note may have, and the provenance of notes that may be written over.
RESERVED, MACHINE_MADE = ("index", "log"), ("extracted", "inferred")
CONNECTIONS, DEFAULT_RELATION = 30, "related_to"


def canonical_path(path: Column) -> Column:
    """A note's path below the bundle's root, or null for one that may not be written: absolute, leading out, hidden,
    reserved, with control signs, or no ``.md``."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    bad = p.rlike(r"[\x00-\x1f\x7f]|^/|^[A-Za-z]:") | F.exists(parts, lambda x: x.isin("", ".", "..") | x.startswith(".")) | ~F.endswith(p, F.lit(".md"))
    name = F.lower(F.regexp_replace(F.element_at(parts, -1), r"\.md$", ""))
    return F.when(~bad & ~name.isin(*RESERVED) & (name != ""), p)


def header_value(value: Column) -> Column:
    """A text as a header line holds it: quoted where it would be read as something else."""
    plain = T.control_free(value)
    quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit("'")), F.lit('"'))
    special = plain.rlike(r"""^[\s\[\]{}"'#&*!|>%@`,-]|[:#,]|\s$|^(?i)(?:true|false|null|[+-]?\d+(?:\.\d*)?)$""") | (plain == "")
    return F.when(special, quoted).otherwise(plain)


def rendered(meta: dict[str, Column], body: Column) -> Column:
    """A note's text: its header in order, lists in brackets, then its body; null and empty values have no line."""
    lines = []
    for key, value in meta.items():
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value)))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+$", ""), F.lit("\n"))


def header_list(values: Column) -> Column:
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(F.transform(kept, header_value), ", "), F.lit("]")))


def write_notes(notes: DataFrame, path: str, text: str, root: str) -> int:
    """Writes (path, text) rows below ``root``, which executors and driver share, each by replacing its file whole; the
    number written. A path that may not be written is an error before anything is."""
    checked = notes.select(canonical_path(F.col(path)).alias("p"), F.col(text).alias("t"), F.col(path).alias("given"))
    wrong = checked.where("p IS NULL").limit(1).collect()
    if wrong:
        raise ValueError(f"not a note's path: {wrong[0]['given']!r}")

    def put(rows) -> None:
        import os
        import tempfile

        for r in rows:
            target = os.path.join(root, r["p"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            handle, spare = tempfile.mkstemp(dir=os.path.dirname(target), prefix=".")
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(r["t"] or "")
            os.replace(spare, target)

    checked.foreachPartition(put)
    return checked.count()


def stale_links(links: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key): notes whose links (key, name) must be led anew after a write: they have a name that now means another note,
    of identities (name, target) before and after."""
    moved = before.select("name", F.col("target").alias("b")).join(after.select("name", F.col("target").alias("a")), "name", "full").where("NOT (a <=> b)").select("name")
    return links.join(moved, "name", "left_semi").select(key).distinct()


def paths_of(nodes: DataFrame, order: str) -> DataFrame:
    """``nodes`` (id, label, folder) with ``path``: a file name made of the label, numbered where it is taken already."""
    label = F.coalesce(F.nullif(T.link_safe(F.col("label")), F.lit("")), F.nullif(T.link_safe(F.col("id").cast("string")), F.lit("")), F.lit("unnamed"))
    slug = T.slug(label)
    base = F.concat_ws("/", F.nullif("folder", F.lit("")), F.when(slug.isin(*RESERVED), F.concat(slug, F.lit("-node"))).otherwise(slug))
    named = nodes.withColumn("label", label).withColumn("_base", base)
    numbered = named.withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(order, "id")))
    return numbered.withColumn("path", F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(F.lit("")), F.lit(".md"))).drop("_base", "_n")


def notes_from_graph(nodes: DataFrame, links: DataFrame, existing: DataFrame, order: str = "ordinal", plan: Callable[[DataFrame], DataFrame] | None = None, connections: int | None = CONNECTIONS) -> DataFrame:
    """(id, path, label, body, state) of nodes (id, label, folder, body, ordinal) and links (source, target, relation,
    confidence, n): each node as a note with its first ``connections`` links as typed lines (None: all).

    ``existing`` has (path, title, provenance, body). A note that no import wrote is kept: ``protected``, and links to
    or from it are left out. Of one that an import wrote, inferred typed lines that the new body lacks are carried
    over. A label that several notes have is linked by path. ``state`` is new, changed, same or protected. ``plan``
    may change or drop nodes first.
    """
    given = paths_of(plan(nodes) if plan else nodes, order)
    old = existing.select("path", F.col("provenance"), F.coalesce("body", F.lit("")).alias("_old"))
    placed = given.join(old, "path", "left").withColumn("_kept", F.col("_old").isNotNull() & ~F.coalesce(F.col("provenance").isin(*MACHINE_MADE), F.lit(False)))
    ends = placed.where("NOT _kept").select("id", "path", "label")
    owned = existing.select("path", F.coalesce("title", F.lit("")).alias("label")).unionByName(ends.select("path", "label")).select(T.normal_name(F.col("label")).alias("_name"), "path").where("_name <> ''").distinct()
    shared = owned.groupBy("_name").agg(F.count(F.lit(1)).alias("_owners")).where("_owners > 1")
    to = ends.withColumn("_name", T.normal_name(F.col("label"))).join(shared, "_name", "left")
    to = to.select(F.col("id").alias("target"), F.when(F.col("_owners").isNull(), F.col("label")).otherwise(F.concat("path", F.lit("|"), "label")).alias("_ref"))
    relation = F.coalesce(F.nullif(T.link_safe(F.col("relation")), F.lit("")), F.lit(DEFAULT_RELATION))
    confidence = F.lower(F.coalesce(F.nullif(F.regexp_replace(T.link_safe(F.col("confidence")), r"\s+", "-"), F.lit("")), F.lit("inferred")))
    out = links.join(ends.select(F.col("id").alias("source")), "source", "left_semi").join(to, "target")
    line = F.concat(F.lit("- "), relation, F.lit(" [["), "_ref", F.lit("]] ("), confidence, F.lit(")"))
    told = out.select("source", "n", line.alias("line"), F.row_number().over(Window.partitionBy("source").orderBy("n", "target")).alias("_r"))
    told = told.where(F.col("_r") <= connections) if connections else told
    joined = told.groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "line"))), lambda x: x["line"]), "\n").alias("_lines"))
    full = placed.join(joined, "id", "left")
    own = F.trim(F.coalesce("body", F.lit("")))
    fresh = F.concat_ws("\n\n", F.nullif(own, F.lit("")), F.concat(F.lit("## Connections\n\n"), F.col("_lines")))
    full = full.withColumn("_new", F.coalesce(F.nullif(fresh, F.lit("")), F.col("label")))
    inferred = F.regexp_extract_all(F.coalesce("_old", F.lit("")), F.lit(r"(?mi)^- [\w-]+ \[\[[^\[\]\n]+\]\] \(inferred\)[ \t]*$"), F.lit(0))
    carried = F.array_join(F.array_except(inferred, F.split("_new", "\n")), "\n")
    body = F.when(carried == "", F.col("_new")).when(F.col("_new").contains("# Connections"), F.concat("_new", F.lit("\n"), carried)).otherwise(F.concat("_new", F.lit("\n\n## Connections\n\n"), carried))
    done = full.withColumn("body", F.when(F.col("_kept"), F.col("_old")).otherwise(body))
    state = F.when(F.col("_kept"), "protected").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("body"), "same").otherwise("changed")
    return done.select("id", "path", "label", "body", state.alias("state"))


def rule_pages(rules: DataFrame) -> DataFrame:
    """(domain, body): the rules of each domain (domain, rule_id, text, count, sessions, status, since) as a page, active
    ones first, superseded ones struck through. A registry holds few rules."""
    live = F.coalesce("status", F.lit("active")) != "superseded"
    line = F.when(live, F.concat(F.lit("- "), "text", F.lit("  *(evidence: "), F.col("count").cast("string"), F.lit(" event(s), "), F.col("sessions").cast("string"), F.lit(" session(s), promoted "), F.coalesce("since", F.lit("")), F.lit(")*")))
    line = line.otherwise(F.concat(F.lit("- ~~"), "text", F.lit("~~  *(superseded "), F.coalesce("since", F.lit("")), F.lit(")*")))
    rows = rules.select("domain", F.struct(live.cast("int").alias("live"), "rule_id", line.alias("line")).alias("r"))
    per = rows.groupBy("domain").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    part = lambda flag: F.array_join(F.transform(F.filter("rs", lambda r: r["live"] == flag), lambda r: r["line"]), "\n")
    return per.select("domain", F.concat_ws("\n\n", F.nullif(part(1), F.lit("")), F.nullif(part(0), F.lit(""))).alias("body"))


def observed_notes(observed: DataFrame, key: str, value: str, notes: DataFrame) -> DataFrame:
    """(key, path): the note that each observed file means: its own path, its resource, or the longest resource of two
    parts or more with which the observed path ends.

    ``notes`` has (path, resource), a resource belonging to its first note. Each observed path is taken with its ends,
    so both sides meet by equality. What means no note is left out.
    """
    first = notes.where(F.length("resource") > 0).groupBy("resource").agg(F.min("path").alias("path"))
    raw = F.regexp_replace(F.replace(F.trim(value), F.lit("\\"), F.lit("/")), r"^\./", "")
    seen = observed.select(key, raw.alias("_v")).where(F.length("_v") > 0).distinct()
    parts = F.filter(F.split("_v", "/"), lambda p: p != "")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    known = notes.select(F.col("path").alias("_k"), "path", F.lit(0).alias("way")).distinct()
    whole = first.select(F.col("resource").alias("_k"), "path", F.lit(1).alias("way"))
    tail = first.where(F.regexp_replace("resource", "^/+", "").contains("/")).select(F.regexp_replace("resource", "^/+", "").alias("_k"), "path", F.lit(2).alias("way"))
    exact = seen.select(key, "_v", F.col("_v").alias("_k")).join(known.unionByName(whole), "_k")
    ended = seen.select(key, "_v", F.explode(F.when(F.size(parts) > 1, F.array_distinct(ends)).otherwise(F.array().cast("array<string>"))).alias("_k")).where("_k <> _v").join(tail, "_k")
    both = exact.unionByName(ended.select(*exact.columns))
    return both.groupBy(key).agg(F.min(F.struct("way", (-F.length("_k")).alias("n"), "_k", "path")).alias("b")).select(key, "b.path")


def situation_cues(folder: str, branch: str | None = None, changed: list[str] = (), subject: str | None = None, recent: list[str] = ()) -> list[tuple[str, float, str]]:
    """(text, weight, origin) of a working tree: its folder, branch, up to ten changed files, last subject, five recent titles."""
    out = [(folder.rstrip("/").rsplit("/", 1)[-1], 0.8, "folder")] if folder.strip("/") else []
    out += [(branch, 0.6, "branch")] if branch else []
    out += [(p.rsplit("/", 1)[-1], 0.8, "changed") for p in list(changed)[:10]]
    out += [(subject, 0.6, "commit")] if subject else []
    return out + [(t, 0.5, "recent") for t in list(recent)[:5] if t]


def backlinked(edges: DataFrame) -> DataFrame:
    """(node, degree): links and backlinks of each note."""
    return graph.degrees(edges)
