"""Queries over cues, packs, excerpts, extraction, relations, export and the semantic channel, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import activation, blocks, extract, fusion, graph, held, lexical, packs, recall
from quillmesh.plans import sqltext as S
from quillmesh.plans import tables
from quillmesh.plans.graphs import _ACTIVATE, _EDGES, _STATE, _USED, joined, note_edges, note_state, scorer, used_with
from quillmesh.plans.lexical import _CUE_SOURCE, _NOTE_PRELUDE, _SOURCES, code_arms, hybrid
from quillmesh.plans.scalars import superseded
from quillmesh.session import cut, small, table
from quillmesh.sources import bundle, sinks


def query_cues(spark, sf_dir):
    return recall.cues(table(spark, sf_dir, "eval_items"), "item_id", "text")


def facet_recall(spark, sf_dir):
    """Notes for each held-out question over all its cues, weighted."""
    c = recall.cues(tables.note_cues(spark, sf_dir), "cue_id", "text")
    facet = c.select(F.concat_ws(":", "cue_id", "n").alias("facet_id"), "cue", "weight", "cue_id")
    facet = cut(facet)

    def sums(terms):
        ix = blocks.index(tables.notes(spark, sf_dir), "path", tables.note_fields(), terms.drop("cue_id"), "facet_id")
        own = facet.join(terms.select("facet_id").distinct(), "facet_id", "left_semi").select("facet_id", "cue_id", "weight")
        return blocks.weighted_sums(ix, blocks.Arm("overlap", lexical.OVERLAP_WEIGHTS), own, "cue_id", "weight")

    terms = lexical.cue_terms(facet, "facet_id", "cue").join(facet.select("facet_id", "cue_id"), "facet_id")
    return blocks.over(cut(terms), "cue_id", sums).select("cue_id", "path", "score", F.col("n").alias("facets"))


def _chosen(spark, sf_dir):
    """The notes that cover most facets among all current notes that a cue reached, with why they were recalled."""
    n = tables.notes(spark, sf_dir).select(F.col("path").alias("node"), "title", "body", "tags")
    facets = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.substring_index("node", "/", 1)))
    if known := scorer(spark, sf_dir):
        found = cut(held.best(held.with_facets(known, n.select("node", "title", facets.alias("facets"))), spark, "query_id", recall.PACK_NOTES, cover=True))
        picked = found.select("query_id", "node", F.col("rank").alias("position"), "score")
        return picked.join(activation.why(found, "query_id"), ["query_id", "node"]).join(n.select("node", "title", "body"), "node")
    scored = cut(joined(spark, sf_dir, carriers=True))
    current = scored.where("score > 0").join(superseded(spark, sf_dir).withColumnRenamed("path", "node"), "node", "left_anti")
    rows = current.join(n.select("node", "title", facets.alias("facets")), "node")
    picked = cut(recall.cover_select(rows.select("query_id", "node", "score", "title", "facets"), "query_id", "node", pool=None))
    why = activation.why(scored.join(picked.select("query_id", "node"), ["query_id", "node"], "left_semi"), "query_id")
    return picked.join(current.select("query_id", "node", "score"), ["query_id", "node"]).join(why, ["query_id", "node"]).join(n.select("node", "title", "body"), "node")


def cover_select(spark, sf_dir):
    return _chosen(spark, sf_dir).select("query_id", "node", "position", "score")


def _marks(spark, sf_dir, limit=packs.PACK_BUDGET):
    state = note_state(spark, sf_dir).where("strength > 0").select("node", "strength")
    return packs.landmarks(tables.notes(spark, sf_dir), state, graph.degrees(note_edges(spark, sf_dir)), superseded(spark, sf_dir), limit)


def landmarks(spark, sf_dir):
    """The forty notes that an index shows first."""
    return _marks(spark, sf_dir, 40).select(F.col("n").cast("long").alias("n"), "path", "superseded")


def _packs(spark, sf_dir, compact=False):
    n = tables.notes(spark, sf_dir)
    rows = _chosen(spark, sf_dir).withColumnRenamed("node", "path")
    cues = tables.note_cues(spark, sf_dir).withColumnRenamed("cue_id", "query_id")
    return packs.context_packs(cues, rows, "query_id", shown=_marks(spark, sf_dir), notes=n.count(), compact=compact)


def context_pack(spark, sf_dir):
    return _packs(spark, sf_dir)


def compact_pack(spark, sf_dir):
    """The same without an index, by whole blocks that speak to the cue."""
    return _packs(spark, sf_dir, compact=True)


def _texts(spark, sf_dir, chosen):
    """(file, text, symbols) of the chosen files; the texts of all others are not joined."""
    symbols = F.transform("symbol_locations", lambda s: F.struct(s["symbol"].alias("symbol"), s["line"].alias("line")))
    files = tables.sources(spark, sf_dir).join(small(chosen.select("file").distinct()), "file", "left_semi")
    return files.select("file", "text", symbols.alias("symbols"))


def code_pack(spark, sf_dir):
    """The five best files of the hybrid ranking for each question, as one page of excerpts."""
    arms = code_arms(spark, sf_dir, 6)
    best = cut(fusion.protected(arms.where("ranking = 'bm25f'").drop("score"), arms.drop("score"), "cue_id", "file", keep=1, limit=5, unique=True))
    found = arms.join(best.select("cue_id", "file"), ["cue_id", "file"], "left_semi").groupBy("cue_id", "file").agg(F.array_sort(F.collect_list(F.struct(F.col("ranking").alias("arm"), F.col("rank").cast("int").alias("rank")))).alias("arms"))
    ranked = best.join(found, ["cue_id", "file"]).select("cue_id", F.col("file").alias("path"), "rank", "arms")
    files = _texts(spark, sf_dir, best).withColumnRenamed("file", "path")
    out = packs.code_packs(tables.code_cues(spark, sf_dir).select("cue_id", F.col("text").alias("question")), ranked, files, "cue_id", 5)
    return out.select("cue_id", "context", "tokens", F.array_join("packed", ",").alias("packed"), F.array_join("omitted", ",").alias("omitted"))


def code_excerpt(spark, sf_dir):
    """Where the files of the hybrid ranking speak to their question."""
    best = cut(hybrid(spark, sf_dir).where("rank <= 5"))
    files = _texts(spark, sf_dir, best)
    q = tables.code_cues(spark, sf_dir).select("cue_id", F.col("text").alias("question"))
    return recall.excerpts(best.join(files, "file").join(q, "cue_id"), "cue_id", "file")


def extract_graph(spark, sf_dir):
    """Nodes and links of all source files."""
    return extract.facts(tables.sources(spark, sf_dir), "file", "path", "text")


def symbol_relations(spark, sf_dir):
    """How many names the definitions of each file call or inherit."""
    r = extract.symbol_relations(extract_graph(spark, sf_dir), "file")
    return r.groupBy("file", "relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))


def extract_summary(spark, sf_dir):
    return extract_graph(spark, sf_dir).groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def note_headings(spark, sf_dir):
    """Headings of all notes outside code, with their level and order."""
    n = tables.notes(spark, sf_dir).select("path", F.posexplode(F.regexp_extract_all(graph.mask_code(F.col("body")), F.lit(r"(?m)^#{1,6}[ \t]+\S[^\n]*$"), F.lit(0))).alias("n", "h"))
    return n.select("path", F.col("n").cast("long").alias("n"), F.length(F.regexp_extract("h", "^(#+)", 1)).cast("long").alias("level"), F.regexp_replace(F.regexp_replace("h", r"^#+[ \t]+", ""), r"[ \t]*$", "").alias("heading"))


def symbol_table(spark, sf_dir):
    """Symbols of all files with their lines, as the indexer declared them."""
    f = tables.sources(spark, sf_dir).select("file", F.explode("symbol_locations").alias("s"))
    return f.select("file", F.col("s.symbol").alias("symbol"), F.col("s.line").cast("long").alias("line"))


def relation_hits(spark, sf_dir):
    """What each name supplies, imports or relates to: one hop over typed links, by direction."""
    t = cut(graph.typed_links(tables.notes(spark, sf_dir), "path", "body"))
    out = t.select(F.col("path").alias("seed"), "relation", F.lit("out").alias("direction"), F.col("name").alias("answer"), "weight")
    return out.unionByName(t.select(F.col("name").alias("seed"), "relation", F.lit("in").alias("direction"), F.col("path").alias("answer"), "weight"))


def export_graph(spark, sf_dir):
    """The notes and what joins them, links, supersessions and common use, as node-link rows."""
    used = used_with(spark, sf_dir).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("used_with").alias("relation"))
    links = note_edges(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("relation")).unionByName(used)
    return sinks.node_link(tables.notes(spark, sf_dir).select(F.col("path").alias("id")), cut(links))


def note_index(spark, sf_dir):
    return sinks.index_lines(tables.notes(spark, sf_dir))


def source_fingerprint(spark, sf_dir):
    return bundle.fingerprint(table(spark, sf_dir, "source_records"), "path", "text")


def repository_sizes(spark, sf_dir):
    f = tables.sources(spark, sf_dir)
    return f.groupBy("repository").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"), F.sum(F.size("symbols")).alias("symbols"))


def semantic_seeds(spark, sf_dir):
    """What the semantic channel adds: twice the cosine above the floor of 0.3, for queried vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = e.join(small(q, 2_000), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", T.cosine(F.col("q"), F.col("embedding")).alias("c"))
    return s.where("c > 0.3").select("query_id", "vec_id", F.round(2 * (F.col("c") - 0.3), 6).alias("seed"))


def duplicate_slugs(spark, sf_dir):
    """Titles that several notes share, and the paths that would clash."""
    n = tables.notes(spark, sf_dir).select("path", T.slug(F.col("title")).alias("slug"))
    return n.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last")).where("n > 1")


def guard_hits(spark, sf_dir):
    """Excerpts whose file lies under a folder that a scored file guards, by folder."""
    g = table(spark, sf_dir, "code_memory_evidence").where("protected").select("repository", T.directory(T.clean_path(F.col("path"))).alias("guard")).where("guard <> ''").distinct()
    x = table(spark, sf_dir, "code_excerpts").select("excerpt_id", "repository", T.clean_path(F.col("path")).alias("p"))
    # A file's folders are few: they meet the guards by equality instead of every guard meeting every file.
    parts = F.split(T.directory(F.col("p")), "/")
    up = x.select("excerpt_id", "repository", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("guard"))
    return up.join(g, ["repository", "guard"]).groupBy("repository", "guard").agg(F.countDistinct("excerpt_id").alias("excerpts"))


QUERIES = {f.__name__: f for f in (query_cues, facet_recall, cover_select, landmarks, context_pack, compact_pack, code_pack, code_excerpt, extract_graph, extract_summary, symbol_relations, note_headings, symbol_table, relation_hits, export_graph, note_index, source_fingerprint, repository_sizes, semantic_seeds, duplicate_slugs, guard_hits)}

from quillmesh.plans.graphs import _MASK, _TYPED  # noqa: E402

_SLUG = "trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')"
_CP = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"

def _cue_parts(source: str, key: str) -> str:
    """CTEs ending in ``cp`` (key, n, cue, weight, origin): the parts of questions; these have no quotations in the tables."""
    words = rf"regexp_extract_all(lower(whole), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_.-]*')"
    rare = f"NOT list_contains({S.STOP}, w) AND (length(w) >= 5 OR regexp_matches(w, '[0-9]'))"
    runs = f"list_transform(string_split(array_to_string(list_transform({words}, lambda w: CASE WHEN {rare} THEN w ELSE chr(1) END), ' '), chr(1)), lambda r: list_filter(string_split(trim(r), ' '), lambda x: x <> ''))"
    return rf"""qq AS (SELECT {key}, text AS raw, trim(regexp_replace(text, '\s+', ' ', 'g')) AS whole FROM {source} WHERE text IS NOT NULL), cl AS (SELECT {key}, flatten(list_transform(regexp_split_to_array(raw, '[.?!;\n]+'), lambda s: regexp_split_to_array(s, '(?i),|\b(?:and|or|but|versus|vs)\b'))) AS c FROM qq),
rr AS (SELECT {key}, unnest(r) AS run, unnest(range(1, len(r) + 1)) AS i FROM (SELECT {key}, {runs} AS r FROM qq)), ra AS (SELECT {key}, array_to_string(run[1:3], ' ') AS cue, row_number() OVER (PARTITION BY {key} ORDER BY len(run) DESC, i) AS i FROM rr WHERE len(run) > 0 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY len(run) DESC, i) <= 4),
pa AS (SELECT {key}, 0 AS k, 0 AS i, whole AS cue, 1.0 AS weight, 'query' AS origin, 1 AS least FROM qq UNION ALL SELECT {key}, 2, i, trim(regexp_replace(c[i], '\s+', ' ', 'g')), 0.7, 'clause', 2 FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM cl WHERE len(c) > 1) UNION ALL SELECT {key}, 3, i, cue, 0.5, 'rare', 1 FROM ra),
pt AS (SELECT *, list_sort(list_distinct({S.terms('cue')})) AS t FROM pa), pf AS (SELECT * FROM pt WHERE len(t) >= least QUALIFY row_number() OVER (PARTITION BY {key}, t ORDER BY k, i) = 1),
cp AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY k, i) - 1 AS n, cue, weight::DOUBLE AS weight, origin, t FROM pf QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY k, i) <= 10)"""


ORACLE = {
    "query_cues": f"WITH {_cue_parts('eval_items', 'item_id')} SELECT item_id, n, cue, weight, origin FROM cp",
    "facet_recall": f"""{_NOTE_PRELUDE}, {_cue_parts(_CUE_SOURCE, 'cue_id')}, cf AS (SELECT cue_id, n, weight, unnest(t) AS term, len(t) AS size FROM cp), sf AS (SELECT cue_id, n, path, max(weight) AS weight, round(sum({S.weight(lexical.OVERLAP_WEIGHTS)}) / max(size), 6) AS score FROM posts JOIN cf USING (term) GROUP BY ALL)
SELECT cue_id, path, sum(weight::DECIMAL(2,1) * score::DECIMAL(18,6))::DOUBLE AS score, count(*) AS facets FROM sf GROUP BY ALL""",
    "landmarks": f"""WITH {S.NOTES}, {_EDGES}, {_STATE}, dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) GROUP BY node)
SELECT * FROM (SELECT row_number() OVER (ORDER BY CASE WHEN strength > 0 THEN strength END DESC NULLS LAST, coalesce(list_contains(tags, 'test'), false), coalesce(degree, 0) DESC, path) AS n, path, path IN (SELECT path FROM sup) AS superseded
FROM notes1 LEFT JOIN ns ON ns.node = path LEFT JOIN dg ON dg.node = path WHERE strength > 0 OR note_type IS DISTINCT FROM 'import') WHERE n <= 40""",
    # A pick by facets: the first row, rows that bring a facet no earlier row has, then rows of new titles; five in all.
    "cover_select": f"""{_ACTIVATE}, cu AS (SELECT query_id, node, score, lower(trim(coalesce(title, ''))) AS t, list_distinct(list_append(coalesce(tags, []), split_part(node, '/', 1))) AS f, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS r FROM bl JOIN notes1 ON node = path WHERE score > 0 AND node NOT IN (SELECT path FROM sup)),
ff AS (SELECT query_id, min(r) AS r FROM (SELECT query_id, r, unnest(f) AS x FROM cu) GROUP BY query_id, x), ld AS (SELECT * FROM (SELECT DISTINCT query_id, r FROM ff) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r) <= 5),
ot AS (SELECT query_id, min(r) AS r FROM cu c WHERE NOT EXISTS (SELECT 1 FROM ld WHERE ld.query_id = c.query_id AND ld.r = c.r) AND NOT EXISTS (SELECT 1 FROM ld JOIN cu d ON d.query_id = ld.query_id AND d.r = ld.r WHERE ld.query_id = c.query_id AND d.t = c.t) GROUP BY query_id, t),
al AS (SELECT query_id, r, 0 AS g FROM ld UNION ALL SELECT query_id, r, 1 FROM ot), pk AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY g, r) <= 5)
SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS position FROM pk JOIN cu USING (query_id, r)""",
    "note_headings": rf"""WITH {S.NOTES}, h AS (SELECT path, regexp_extract_all({_MASK}, '(?m)^#{{1,6}}[ \t]+\S[^\n]*$') AS hs FROM notes1), u AS (SELECT path, unnest(range(1, len(hs) + 1)) AS i, hs FROM h)
SELECT path, i - 1 AS n, length(regexp_extract(hs[i], '^(#+)', 1)) AS level, regexp_replace(regexp_replace(hs[i], '^#+[ \t]+', ''), '[ \t]*$', '') AS heading FROM u""",
    "symbol_table": f"WITH {_SOURCES} SELECT file, s.symbol AS symbol, s.line::BIGINT AS line FROM (SELECT file, unnest(symbol_locations) AS s FROM src)",
    "relation_hits": f"WITH {S.NOTES}, {_TYPED} SELECT path AS seed, relation, 'out' AS direction, name AS answer, weight FROM tl UNION ALL SELECT name, relation, 'in', path, weight FROM tl",
    "export_graph": f"""WITH {S.NOTES}, {_EDGES}, {_USED} SELECT 'node' AS part, '{{"id":' || to_json(path) || '}}' AS json FROM notes1
UNION ALL SELECT 'link', '{{"source":' || to_json(src) || ',"target":' || to_json(dst) || ',"relation":"' || kind || '"}}' FROM (SELECT src, dst, kind FROM ed UNION ALL SELECT a, b, 'used_with' FROM uw)""",
    "note_index": f"WITH {S.NOTES} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS folder, path, '* [' || coalesce(title, '') || '](/' || path || ')' || CASE WHEN length(description) > 0 THEN ' - ' || description ELSE '' END AS line FROM notes1",
    "repository_sizes": f"WITH {_SOURCES} SELECT repository, count(*) AS files, sum(coalesce(length(text), 0))::BIGINT AS chars, sum(len(symbols))::BIGINT AS symbols FROM src GROUP BY repository",
    "semantic_seeds": "SELECT q.vec_id AS query_id, e.vec_id, round(2 * (list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) - 0.3), 6) AS seed FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) > 0.3",
    "duplicate_slugs": f"WITH {S.NOTES}, s AS (SELECT path, CASE WHEN s IS NULL OR s = '' THEN 'unnamed' WHEN length(s) > 120 THEN rtrim(left(s, 120), '-') || '-' || left(sha256(s), 8) ELSE s END AS slug FROM (SELECT path, {_SLUG} AS s FROM notes1)) SELECT slug, count(*) AS n, min(path) AS first, max(path) AS last FROM s GROUP BY slug HAVING count(*) > 1",
    "guard_hits": rf"""WITH g AS (SELECT DISTINCT repository, regexp_extract({_CP}, '^(.*)/[^/]*$', 1) AS guard FROM code_memory_evidence WHERE protected)
SELECT g.repository, guard, count(DISTINCT excerpt_id) AS excerpts FROM g JOIN (SELECT excerpt_id, repository, {_CP} AS p FROM code_excerpts) x ON x.repository = g.repository AND starts_with(p, guard || '/') WHERE guard <> '' GROUP BY ALL""",
}
