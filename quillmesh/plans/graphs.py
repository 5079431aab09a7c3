"""Queries over links, graphs, walks and source dependencies, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import activation, blocks, graph, held, learning, lexical
from quillmesh.plans import sqltext as S
from quillmesh.plans import tables
from quillmesh.plans.lexical import _CUE_SOURCE, _NOTE_OVERLAP, _NOTE_PRELUDE, _cues, _note_hits
from quillmesh.session import cut, small, snapshot, table


def wiki_links(spark, sf_dir):
    return graph.wiki_links(tables.notes(spark, sf_dir), "path", "body")


def typed_links(spark, sf_dir):
    return graph.typed_links(tables.notes(spark, sf_dir), "path", "body")


def _names(spark, sf_dir):
    from quillmesh.plans.scalars import superseded

    n = tables.notes(spark, sf_dir)
    return n, graph.identities(n, superseded(spark, sf_dir))


def links_resolve(spark, sf_dir):
    """Links and supersessions between notes, by path, file name and title, where they mean one note."""
    n, names = _names(spark, sf_dir)
    over = n.select("path", F.explode("supersedes").alias("wiki")).withColumn("markdown", F.lit(None).cast("string"))
    return graph.resolve_links(graph.note_links(n, "path", "body").unionByName(over), n, names, "path")


def backlinks(spark, sf_dir):
    """How many notes link to each name, and the first of them; who all of them are is ``wiki_links``."""
    return wiki_links(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def note_edges(spark, sf_dir):
    """(src, dst, weight, kind): links between notes; typed links carry their confidence."""
    return snapshot(spark, sf_dir, "note_edges", lambda: _note_edges(spark, sf_dir))


def _note_edges(spark, sf_dir):
    n, names = _names(spark, sf_dir)
    typed = graph.typed_links(n, "path", "body").select("path", F.col("name").alias("wiki"), F.lit(None).cast("string").alias("markdown"), "weight")
    plain = graph.note_links(n, "path", "body").withColumn("weight", F.lit(1.0))
    both = typed.withColumn("kind", F.lit("typed")).unionByName(plain.withColumn("kind", F.lit("link")))
    out = graph.resolve_links(both, n, names, "path").select(F.col("path").alias("src"), F.col("target").alias("dst"), "weight", "kind")
    over = n.select("path", F.explode("supersedes").alias("target")).join(n.select(F.col("path").alias("target")), "target", "left_semi")
    return out.unionByName(over.select(F.col("path").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("weight"), F.lit("supersedes").alias("kind")).distinct())


def used_with(spark, sf_dir):
    """(a, b, w): notes whose feedback came in the same session, the feedback of a note having its number."""
    f = table(spark, sf_dir, "feedback_events").where("session_id IS NOT NULL").select(F.col("event_id").alias("note_id"), "session_id", "ts").distinct()
    n = tables.notes(spark, sf_dir).select("note_id", "path")
    order = Window.partitionBy("session_id").orderBy("ts", "path")
    return graph.co_use(f.join(n, "note_id").select("session_id", "path", F.row_number().over(order).alias("pos")), "session_id", "path", "pos")


def merged_graph(spark, sf_dir):
    """Links and common use between current notes, undirected, the heaviest of a pair."""
    return snapshot(spark, sf_dir, "merged_graph", lambda: _merged_graph(spark, sf_dir))


def _merged_graph(spark, sf_dir):
    from quillmesh.plans.scalars import superseded

    gone = superseded(spark, sf_dir)
    used = used_with(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.least(F.lit(1.0), F.col("w") / 3.0).alias("weight"), F.lit("co-use").alias("kind"))
    edges = note_edges(spark, sf_dir).where("kind <> 'supersedes'").unionByName(used)
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("path", end), end, "left_anti")
    return graph.merged(edges)


def graph_summary(spark, sf_dir):
    return note_edges(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.round(F.sum("weight"), 4).alias("weight"))


def graph_degrees(spark, sf_dir):
    return graph.degrees(note_edges(spark, sf_dir))


def note_state(spark, sf_dir):
    """(node, strength, streak): what the ledger says of each note; the stream's note k stands for the notes whose id ends in k."""
    return snapshot(spark, sf_dir, "note_state", lambda: _note_state(spark, sf_dir))


def _note_state(spark, sf_dir):
    from quillmesh.plans.ledgers import priorities, waste_streak

    n = tables.notes(spark, sf_dir).select(F.col("path").alias("node"), (F.col("note_id") % 100).cast("string").alias("note"), F.coalesce("pinned", F.lit(False)).alias("pinned"))
    known = n.join(priorities(spark, sf_dir), "note", "left").join(waste_streak(spark, sf_dir), "note", "left")
    strength = activation.floored(known.select("node", F.coalesce("priority", F.lit(0.0)).alias("strength")), known.where("pinned").select("node"))
    return known.select("node", F.coalesce("streak", F.lit(0).cast("long")).alias("streak")).join(strength, "node")


def goal_relevance(spark, sf_dir):
    """(node, goal): how well each note answers the goal it answers best, of those it is about."""
    return snapshot(spark, sf_dir, "goal_relevance", lambda: _goal_relevance(spark, sf_dir))


def _goal_relevance(spark, sf_dir):
    from quillmesh.plans.scalars import aligned_fields

    goals = table(spark, sf_dir, "notes").where("note_id % 100 = 0 AND length(title) > 0").select(F.col("note_id").alias("goal_id"), F.col("title").alias("text"))
    terms = cut(lexical.cue_terms(goals, "goal_id", "text"))

    def best(part):
        ix = blocks.index(tables.notes(spark, sf_dir), "path", tables.note_fields() | aligned_fields(), part, "goal_id")
        return blocks.best_goal(ix, blocks.Arm("overlap", lexical.OVERLAP_WEIGHTS), "all", "plain")

    return blocks.over(terms, "goal_id", best).groupBy(F.col("path").alias("node")).agg(F.max("goal").alias("goal"))


def _learned(spark, sf_dir):
    """(node, term, w): what positive feedback taught of the note that has its number."""
    f = table(spark, sf_dir, "feedback_events").where("polarity > 0 AND text IS NOT NULL").select(F.col("event_id").alias("note_id"), "session_id", "text").distinct()
    said = f.join(tables.notes(spark, sf_dir).select("note_id", F.col("path").alias("node")), "note_id")
    return learning.associations(said.withColumn("session_id", F.coalesce("session_id", F.lit(""))), "session_id", "node", F.col("text")).select("node", F.explode(F.split("tokens", " ")).alias("term"), "w")


def _channels(spark, sf_dir):
    """(cues' terms, amounts by similarity, what was learned) of the seeds of each cue."""
    n, cues = tables.notes(spark, sf_dir), cut(_cues(spark, sf_dir))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = small(tables.note_cues(spark, sf_dir).select(F.col("cue_id").alias("query_id")).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("q")), 2_000)
    embedded = n.join(vectors, F.col("note_id") == F.col("vec_id")).select(F.col("path").alias("node"), "embedding")
    near = embedded.join(asked).select("query_id", "node", F.lit(1.0).alias("weight"), T.cosine(F.col("q"), F.col("embedding")).alias("cosine"))  # a stated query set against all rows
    return cues, activation.semantic(near, "query_id"), snapshot(spark, sf_dir, "learned", lambda: _learned(spark, sf_dir))


def _gone(spark, sf_dir):
    from quillmesh.plans.scalars import superseded

    return superseded(spark, sf_dir).withColumnRenamed("path", "node")


def _tests(spark, sf_dir):
    return tables.notes(spark, sf_dir).where(F.array_contains("tags", "test")).select(F.col("path").alias("node"))


def scorer(spark, sf_dir):
    """What scores the notes of one cue after the other in a task, or None where that is too much to be sent to it."""
    cues, near, learned = _channels(spark, sf_dir)
    notes = held.hold(tables.notes(spark, sf_dir), "path", tables.note_fields(), tables.note_cues(spark, sf_dir), cues, "cue_id", lexical.OVERLAP_WEIGHTS)
    if notes is None:
        return None
    state = note_state(spark, sf_dir)
    flow = graph.shares(graph.adjacency(merged_graph(spark, sf_dir)), activation.prior(state))
    return held.scorer(notes, _tests(spark, sf_dir), _gone(spark, sf_dir), near, learned, flow, state, goal_relevance(spark, sf_dir), "query_id")


def joined(spark, sf_dir, carriers=False):
    """The scores of all cues and notes by joins, for more notes than a task can hold."""
    cues, near, learned = _channels(spark, sf_dir)
    lex = lexical.overlap_hits(_note_hits(spark, sf_dir, cues), "path", cues, "cue_id", lexical.OVERLAP_WEIGHTS).select(F.col("cue_id").alias("query_id"), F.col("path").alias("node"), F.col("score").alias("amount"))
    lex = activation.damped(lex, _tests(spark, sf_dir), "query_id")
    seeded = activation.seeds(lex, "query_id", _gone(spark, sf_dir), near, activation.associated(cues.withColumnRenamed("cue_id", "query_id"), learned, "query_id"))
    state = note_state(spark, sf_dir)
    return activation.activate(seeded, merged_graph(spark, sf_dir), "query_id", state.select("node", "strength"), goal_relevance(spark, sf_dir), state.where(f"streak >= {activation.WASTE_RUN}").select("node"), carriers=carriers)


def activate(spark, sf_dir):
    """The complete scorer: lexical, semantic and learned seeds of each cue, three damped steps over the merged graph,
    bounded blend, scaled by strength, goals and waste."""
    known = scorer(spark, sf_dir)
    return held.activated(known, spark, "query_id") if known else joined(spark, sf_dir)


def recall_why(spark, sf_dir):
    """One line on each of the ten best current notes of each cue."""
    if known := scorer(spark, sf_dir):
        return activation.why(held.best(known, spark, "query_id", 10), "query_id")
    scored = cut(joined(spark, sf_dir, carriers=True))
    return activation.why(scored.join(_top(scored, spark, sf_dir).select("query_id", "node"), ["query_id", "node"], "left_semi"), "query_id")


def _top(scored, spark, sf_dir, k=10):
    current = scored.where("score > 0").join(_gone(spark, sf_dir), "node", "left_anti")
    return current.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")).cast("long")).where(f"rank <= {k}")


def recall_topk(spark, sf_dir):
    """The ten best current notes of each cue."""
    known = scorer(spark, sf_dir)
    return held.best(known, spark, "query_id", 10).select("node", "query_id", "score", "rank") if known else _top(joined(spark, sf_dir), spark, sf_dir)


def co_use(spark, sf_dir):
    """Parts that orders use together."""
    touches = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")).alias("pos"))
    return graph.co_use(touches, "l_orderkey", "l_partkey", "pos")


QUERIES = {f.__name__: f for f in (wiki_links, typed_links, links_resolve, backlinks, used_with, merged_graph, graph_summary, graph_degrees, note_state, goal_relevance, activate, recall_topk, recall_why, co_use)}

_MASK = r"regexp_replace(regexp_replace(coalesce(body, ''), '(?ms)^(?:```|~~~)[^\n]*\n.*?^(?:```|~~~)[ \t]*$', ' ', 'g'), '`[^`\n]+`', ' ', 'g')"
_MASK = rf"regexp_replace(regexp_replace({_MASK}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(pre|script|style|textarea)\b.*?</(pre|script|style|textarea)>', ' ', 'g')"
_MASK = rf"regexp_replace({_MASK}, '~~[^~\n]+~~|!\[\[[^\[\]\n]*\]\]|!\[[^\[\]\n]*\]\([^()\n]*\)', ' ', 'g')"
_NN = r"lower(regexp_replace(trim({}), '\s+', ' ', 'g'))"
_LINKS = rf"wl AS (SELECT DISTINCT path, {_NN.format('n')} AS name FROM (SELECT path, unnest(regexp_extract_all({_MASK}, '\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]', 1)) AS n FROM notes1))"
_TYPED = rf"""tl AS (SELECT path, relation, name, arg_max(conf, (weight, conf)) AS confidence, max(weight) AS weight FROM (SELECT path, regexp_extract(l, p, 1) AS relation, {_NN.format('regexp_extract(l, p, 2)')} AS name, coalesce(nullif(regexp_extract(l, p, 3), ''), 'extracted') AS conf,
CASE coalesce(nullif(regexp_extract(l, p, 3), ''), 'extracted') WHEN 'extracted' THEN 1.0 WHEN 'inferred' THEN 0.5 WHEN 'ambiguous' THEN 0.2 ELSE 0.5 END::DOUBLE AS weight FROM (SELECT path, p, unnest(regexp_extract_all({_MASK}, p)) AS l FROM notes1, (SELECT '(?m)^- ([\w-]+) \[\[([^\[\]|\n]+)\]\](?: \((\w+)\))?[ \t]*$' AS p))) GROUP BY ALL)"""
_TYPED = _TYPED.replace("regexp_extract_all(" + _MASK + ", p)", "regexp_extract_all(" + _MASK + r", '(?m)^- [\w-]+ \[\[[^\[\]|\n]+\]\](?: \(\w+\))?[ \t]*$')").replace("regexp_extract(l, p, ", r"regexp_extract(l, '^- ([\w-]+) \[\[([^\[\]|\n]+)\]\](?: \((\w+)\))?', ").replace("SELECT path, p, unnest", "SELECT path, unnest")
_TYPED = _TYPED[: _TYPED.index(" FROM notes1, (SELECT ")] + " FROM notes1)) GROUP BY ALL)"
# Links as they are written, the names that mean one note, and where each link leads by its first way that leads anywhere.
_SUP = "sup AS (SELECT DISTINCT path FROM (SELECT unnest(supersedes) AS path FROM notes1 UNION ALL SELECT path FROM notes1 WHERE lower(trim(status)) = 'deprecated') WHERE path IN (SELECT path FROM notes1))"
_NAMES = rf"""{_SUP}, ids AS (SELECT DISTINCT path, name FROM (SELECT path, unnest([{_NN.format(r"regexp_replace(split_part(path, '/', -1), '\.md$', '')")}, {_NN.format("coalesce(title, '')")}]) AS name FROM notes1) WHERE name <> ''),
nm AS (SELECT name, CASE WHEN c = 1 THEN one ELSE anyone END AS target FROM (SELECT name, count(*) FILTER (path NOT IN (SELECT path FROM sup)) AS c, min(path) FILTER (path NOT IN (SELECT path FROM sup)) AS one, count(*) AS n, min(path) AS anyone FROM ids GROUP BY name) WHERE c = 1 OR (c = 0 AND n = 1))"""
_PLAIN = rf"regexp_replace({_MASK}, '(?m)^- [\w-]+ \[\[[^\[\]|\n]+\]\](?: \(\w+\))?[ \t]*$', ' ', 'g')"
_RAW = rf"""pl AS (SELECT path, {_PLAIN} AS b FROM notes1), rw AS (SELECT DISTINCT path, unnest(regexp_extract_all(b, '\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]', 1)) AS wiki FROM pl)"""


def _resolved(links: str, name: str, more: str = "") -> str:
    """A CTE of (path, target) of links (path, wiki), by path, path and ``.md``, name, hyphenated name."""
    low = _NN.format("wiki")
    ways = f"[CASE WHEN trim(wiki) IN (SELECT path FROM notes1) THEN trim(wiki) END, CASE WHEN contains(trim(wiki), '/') AND trim(wiki) || '.md' IN (SELECT path FROM notes1) THEN trim(wiki) || '.md' END, a.target, h.target]"
    return f"{name} AS (SELECT DISTINCT path, target{more} FROM (SELECT l.path{more}, list_filter({ways}, lambda x: x IS NOT NULL)[1] AS target FROM {links} l LEFT JOIN nm a ON a.name = {low} LEFT JOIN nm h ON h.name = replace({low}, ' ', '-')) WHERE target IS NOT NULL AND target <> path)"


_EDGES = f"""{_NAMES}, {_RAW}, {_TYPED}, tw AS (SELECT path, name AS wiki, weight FROM tl), {_resolved('rw', 'rl')}, {_resolved('tw', 'rt', ', weight')},
ed AS (SELECT path AS src, target AS dst, 1.0 AS weight, 'link' AS kind FROM rl UNION ALL SELECT path, target, weight, 'typed' FROM rt UNION ALL SELECT DISTINCT path, s, 1.0, 'supersedes' FROM (SELECT path, unnest(supersedes) AS s FROM notes1) WHERE s IN (SELECT path FROM notes1))"""
_USED = """ue AS (SELECT DISTINCT session_id, path, ts FROM feedback_events JOIN notes1 ON event_id = note_id WHERE session_id IS NOT NULL), ut AS (SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY ts, path) AS pos FROM ue),
uf AS (SELECT session_id, path AS o, min(pos) AS first FROM ut GROUP BY ALL), uw AS (SELECT least(path, o) AS a, greatest(path, o) AS b, count(*) AS w FROM ut JOIN uf USING (session_id) WHERE first < pos AND path <> o GROUP BY 1, 2)"""
_MERGED = f"""{_USED}, ae AS (SELECT * FROM ed WHERE kind <> 'supersedes' UNION ALL SELECT a, b, least(1.0, w / 3.0), 'co-use' FROM uw),
mg AS (SELECT a, b, max(weight) AS weight, arg_max(kind, (weight, CASE kind WHEN 'link' THEN 2 WHEN 'typed' THEN 1 ELSE 0 END)) AS kind FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, weight, kind FROM ae WHERE src <> dst AND src NOT IN (SELECT path FROM sup) AND dst NOT IN (SELECT path FROM sup)) GROUP BY ALL)"""


def _walk_sql(seeds: str, flow: str, factors: list[float]) -> str:
    steps, last = [], seeds
    for i, f in enumerate(factors, 1):
        steps.append(f"s{i} AS (SELECT query_id, dst AS node, sum(x) AS amount FROM (SELECT query_id, dst, amount * {f} * share AS x FROM {last} JOIN {flow} ON node = src WHERE amount > 1e-9) WHERE x > 1e-9 GROUP BY ALL)")
        last = f"s{i}"
    union = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, len(factors) + 1))
    return ",\n".join(steps) + f",\nwk AS (SELECT query_id, node, sum(amount) AS walk FROM ({union}) GROUP BY ALL)"


_EV = """ev AS (SELECT event_id AS ordinal, props->>'$.k' AS note, CASE event_type WHEN 'view' THEN 'recall' WHEN 'click' THEN 'touch' WHEN 'purchase' THEN 'encode' WHEN 'error' THEN 'outcome' ELSE 'session-begin' END AS kind, least(1.0, value / 100) AS valence FROM events)"""
_STATE = f"""{_EV}, us AS (SELECT note, count_if(kind IN ('touch', 'encode')) AS u, count_if(kind = 'recall') AS r, round(coalesce(max(CASE WHEN kind IN ('touch', 'encode') THEN abs(valence) END), 0), 6) AS af, coalesce(max(CASE WHEN kind IN ('touch', 'encode') THEN ordinal END), -1) AS used FROM ev GROUP BY note),
wa AS (SELECT note, count_if(kind = 'recall' AND ordinal > used)::BIGINT AS streak FROM ev JOIN us USING (note) GROUP BY note),
ns AS (SELECT path AS node, greatest(coalesce(round(0.1 * least(10, r) / 10 + CASE WHEN u > 0 THEN 0.3 + 0.4 * least(10, u) / 10 + 0.3 * least(1.0, af) ELSE 0 END, 4), 0), CASE WHEN coalesce(pinned, false) THEN 0.5 ELSE 0 END)::DOUBLE AS strength, coalesce(streak, 0)::BIGINT AS streak
FROM notes1 LEFT JOIN us ON us.note = (note_id % 100)::VARCHAR LEFT JOIN wa ON wa.note = us.note)"""
_WHOLE = "concat_ws(' ', title, array_to_string(tags, ' '), description, body)"
_OUTSIDE = "array_to_string(list_filter(regexp_split_to_array(" + _WHOLE + ", '[ \t\n\r\f\x0b]+'), lambda w: NOT contains(w, '/') AND NOT starts_with(lower(w), 'www.')), ' ')"
_GOALS = f"""gt AS (SELECT note_id AS goal_id, unnest(t) AS term, len(t) AS n FROM (SELECT note_id, list_distinct({S.terms('title')}) AS t FROM notes WHERE note_id % 100 = 0 AND length(title) > 0)),
gd AS (SELECT path, unnest(list_distinct({S.terms(_WHOLE)})) AS term, list_distinct({S.terms(_OUTSIDE)}) AS pl FROM notes1), gh AS (SELECT goal_id, path FROM gd JOIN gt USING (term) GROUP BY ALL HAVING count(*) >= 2 OR count_if(list_contains(pl, term)) >= 1),
gl AS (SELECT path AS node, max(score) AS goal FROM (SELECT goal_id, path, round(sum({S.weight(lexical.OVERLAP_WEIGHTS)}) / max(n), 6) AS score FROM posts JOIN gt USING (term) GROUP BY ALL) JOIN gh USING (goal_id, path) GROUP BY path)"""
_FLOW = "adj AS (SELECT a AS src, b AS dst, weight FROM mg UNION ALL SELECT b, a, weight FROM mg), aw AS (SELECT src, dst, weight * (0.25 + strength) AS w FROM adj JOIN ns ON dst = node), fl AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM aw)"
_LEARNED = f"""lf AS (SELECT DISTINCT path AS node, session_id, text FROM feedback_events JOIN notes1 ON event_id = note_id WHERE polarity > 0 AND text IS NOT NULL), lt AS (SELECT DISTINCT node, unnest({S.terms('text')}) AS term FROM lf),
lk AS (SELECT *, (SELECT least(1.0, count(DISTINCT coalesce(session_id, '')) * 0.5) FROM lf WHERE lf.node = q.node) AS w FROM (SELECT node, term, row_number() OVER (PARTITION BY node ORDER BY length(term) DESC, term) AS r FROM lt) q WHERE r <= 16),
sa AS (SELECT cue_id AS q, node, 0.5 * max(w) * least(1.0, count(*) / 4.0) AS amount FROM lk JOIN cues USING (term) GROUP BY ALL HAVING count(*) >= 2)"""
_SEMANTIC = """se AS (SELECT c.note_id AS q, n.path AS node, 2 * (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 0.3) AS amount FROM notes c JOIN embeddings a ON a.vec_id = c.note_id JOIN notes1 n ON true JOIN embeddings b ON b.vec_id = n.note_id WHERE c.note_id % 100 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3)"""
_ACTIVATE = f"""{_NOTE_PRELUDE}, {S.cue_terms(_CUE_SOURCE, 'cue_id', 'text')}, ov AS ({_NOTE_OVERLAP}), {_EDGES}, {_MERGED}, {_STATE}, {_GOALS}, {_FLOW}, {_LEARNED}, {_SEMANTIC},
lx AS (SELECT cue_id AS q, path AS node, score * CASE WHEN list_contains(tags, 'test') THEN 0.5 ELSE 1 END AS amount FROM ov JOIN notes1 USING (path)), tp AS (SELECT q, max(amount) AS top FROM lx WHERE node NOT IN (SELECT path FROM sup) GROUP BY q),
bd AS (SELECT q, node, 0 AS words, CASE WHEN top > 0 THEN least(amount, 0.4 * top) ELSE amount END AS more FROM (SELECT * FROM se UNION ALL SELECT * FROM sa) LEFT JOIN tp USING (q)),
sq AS (SELECT q AS query_id, node, sum(words)::DOUBLE AS words, (sum(words) + sum(more))::DOUBLE AS amount FROM (SELECT q, node, amount AS words, 0 AS more FROM lx UNION ALL SELECT * FROM bd) GROUP BY ALL), sd AS (SELECT query_id, node, amount FROM sq), {_walk_sql('sd', 'fl', [0.5] * 3)},
re AS (SELECT query_id, node, CASE WHEN words > 0 THEN d * (1 + CASE WHEN w > 0 THEN 0.5 * w / (w + d) ELSE 0 END) WHEN t > 0 AND (d > 0 OR w > 0) THEN least(d + w, 0.4 * t) WHEN d > 0 THEN d + w END AS rel
FROM (SELECT query_id, node, coalesce(words, 0) AS words, coalesce(amount, 0) AS d, coalesce(walk, 0) AS w, coalesce(top, 0) AS t FROM sq FULL JOIN wk USING (query_id, node) LEFT JOIN tp ON tp.q = query_id)),
bl AS (SELECT query_id, node, round(rel * (0.8 + 0.4 * least(1.0, strength)) * (1 + 0.3 * least(1.0, coalesce(goal, 0))) * CASE WHEN streak >= 3 THEN 0.8 ELSE 1 END, 6) AS score FROM re JOIN ns USING (node) LEFT JOIN gl USING (node) WHERE rel IS NOT NULL)"""

ORACLE = {
    "wiki_links": f"WITH {S.NOTES}, {_LINKS} SELECT * FROM wl",
    "typed_links": f"WITH {S.NOTES}, {_TYPED} SELECT * FROM tl",
    "links_resolve": f"WITH {S.NOTES}, {_NAMES}, {_RAW}, al AS (SELECT * FROM rw UNION SELECT path, unnest(supersedes) FROM notes1), {_resolved('al', 'rl')} SELECT * FROM rl",
    "backlinks": f"WITH {S.NOTES}, {_LINKS} SELECT name, count(*) AS n, min(path) AS first, max(path) AS last FROM wl GROUP BY name",
    "used_with": f"WITH {S.NOTES}, {_USED} SELECT * FROM uw",
    "note_state": f"WITH {S.NOTES}, {_STATE} SELECT * FROM ns",
    "goal_relevance": f"{_NOTE_PRELUDE}, {_GOALS} SELECT * FROM gl",
    "merged_graph": f"WITH {S.NOTES}, {_EDGES}, {_MERGED} SELECT a, b, weight::DOUBLE AS weight, kind FROM mg",
    "graph_summary": f"WITH {S.NOTES}, {_EDGES} SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, round(sum(weight), 4)::DOUBLE AS weight FROM ed GROUP BY kind",
    "graph_degrees": f"WITH {S.NOTES}, {_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) GROUP BY node",
    "activate": f"{_ACTIVATE} SELECT * FROM bl",
    "recall_topk": f"""{_ACTIVATE} SELECT * FROM (SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM bl WHERE score > 0 AND node NOT IN (SELECT path FROM sup)) WHERE rank <= 10""",
    "co_use": """WITH t AS (SELECT l_orderkey AS s, l_partkey AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pos FROM lineitem), f AS (SELECT s, n AS o, min(pos) AS first FROM t GROUP BY ALL)
SELECT least(n, o) AS a, greatest(n, o) AS b, count(*) AS w FROM t JOIN f USING (s) WHERE first < pos AND n <> o GROUP BY 1, 2""",
}
