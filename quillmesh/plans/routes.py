"""Queries over routed and structural fusion, entity gates and claims, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import fusion, graph, relations, routing, symbols
from quillmesh.plans import sqltext as S
from quillmesh.plans import tables
from quillmesh.plans.dependencies import source_graph
from quillmesh.plans.graphs import _walk_sql
from quillmesh.plans.lexical import _CODE, _SYMBOLS, code_arms, symbol_labels, symbol_rank
from quillmesh.session import cut, table

TOP = 10


def _graph_arm(spark, sf_dir, arms, both):
    top = arms.where("rank <= 10").select("cue_id", "ranking", "file", "rank")
    seeds = fusion.fused(top, "cue_id", "file", limit=15).select("cue_id", F.col("file").alias("node"), F.col("score").alias("amount"))
    reached = graph.walk(seeds, graph.shares(both), factors=[0.6, 0.36], query="cue_id").withColumn("walk", F.round("walk", 12))
    return reached.select("cue_id", F.lit("graph").alias("ranking"), F.col("node").alias("file"), F.row_number().over(Window.partitionBy("cue_id").orderBy(F.col("walk").desc(), "node")).alias("rank"))


def _symbol_arm(spark, sf_dir):
    s = symbol_rank(spark, sf_dir)
    return s.select("cue_id", F.lit("symbol").alias("ranking"), "file", F.row_number().over(Window.partitionBy("cue_id").orderBy(F.col("score").desc(), "length", "file")).alias("rank"))


def _fused_with(spark, sf_dir, leading=None, placed=None):
    """BM25F, exact, graph and, if given, symbol rankings fused: only files that one of them has in front are placed.
    ``leading`` gives the symbol ranking down to a depth, ``placed`` the ranks of given (cue_id, file) in it."""
    edges = cut(source_graph(spark, sf_dir))
    weights = {"bm25f": 1.0, "exact": 1.0} | ({} if edges.isEmpty() else {"graph": 0.5}) | ({} if leading is None else {"symbol": 1.0})
    depth, others = fusion.contender_depth(list(weights.values()), TOP), []
    ahead = None if leading is None else cut(leading(depth))

    def more(front):
        brought = [] if ahead is None else [ahead.select("cue_id", "file")]
        if "graph" in weights:
            others.append(cut(_graph_arm(spark, sf_dir, front, graph.adjacency(edges))))
            brought.append(others[-1].where(F.col("rank") <= depth).select("cue_id", "file"))
        return reduce(DataFrame.unionByName, brought) if brought else None

    arms = code_arms(spark, sf_dir, TOP, weights=weights, more=more).select("cue_id", "ranking", "file", "rank")
    whole = reduce(DataFrame.unionByName, others, arms)
    if ahead is not None:
        whole = cut(whole)
        pairs = whole.select("cue_id", "file").unionByName(ahead.select("cue_id", "file"))
        whole = whole.unionByName(placed(pairs).select("cue_id", F.lit("symbol").alias("ranking"), "file", "rank"))
    return fusion.fused(whole, "cue_id", "file", {"graph": 0.5}, TOP, unique=True).withColumn("rank", F.col("rank").cast("long"))


def graph_fusion(spark, sf_dir):
    """BM25F and exact rankings fused with two steps over the dependencies, at half weight."""
    return _fused_with(spark, sf_dir)


def structural_fusion(spark, sf_dir):
    """The same with the symbol ranking at full weight."""
    known = symbols.hold(symbol_labels(spark, sf_dir), "file", "label", tables.code_cues(spark, sf_dir), "cue_id", "text")
    if known:
        return _fused_with(spark, sf_dir, lambda depth: symbols.front(known, spark, "cue_id", "file", depth), lambda pairs: symbols.placed(known, pairs, "cue_id", "file"))
    arm = cut(_symbol_arm(spark, sf_dir))
    return _fused_with(spark, sf_dir, lambda depth: arm.where(F.col("rank") <= depth), lambda pairs: arm.join(pairs.distinct(), ["cue_id", "file"], "left_semi"))


def routed_comment(spark, sf_dir):
    """The comment route over our rankings: overlap stands for the current one, BM25F for the semantic, exact for the map."""
    route, keep = routing.ROUTES["comment"][0], sum(n for _, n in routing.ROUTES["comment"][1])
    stands = {"overlap": "current", "bm25f": "semantic", "exact": "repo_map"}
    name = F.when(F.col("ranking") == "overlap", "current").when(F.col("ranking") == "bm25f", "semantic").otherwise("repo_map")
    arms = code_arms(spark, sf_dir, TOP + keep, ("bm25f", "exact", "overlap"), {arm: route[as_] for arm, as_ in stands.items()}).select("cue_id", name.alias("ranking"), "file", "rank")
    return routing.routed(arms, "cue_id", "file", "comment", unique=True).where(F.col("rank") <= TOP).withColumn("rank", F.col("rank").cast("long"))


def eligible_entities(spark, sf_dir):
    """Notes that a question about the title of each queried note certainly names."""
    cues = table(spark, sf_dir, "notes").where("note_id % 100 = 0").select(F.col("note_id").alias("cue_id"), F.concat(F.lit("What do we know about "), F.coalesce("title", F.lit("it")), F.lit(" today?")).alias("text"))
    return routing.eligible_entities(tables.notes(spark, sf_dir), cues, "cue_id", "text")


def _people(spark, sf_dir):
    """(path, type, title, body): customers as people whose notes tell at which nation, a company here, they work or worked."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    verb = F.when(F.col("c_acctbal") < 0, " formerly worked at ").otherwise(" works at ")
    people = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("people/c"), "c_custkey", F.lit(".md")).alias("path"), F.lit("person").alias("type"), F.col("c_name").alias("title"), F.concat(F.lit("[["), "c_name", F.lit("]]"), verb, F.lit("[["), "n_name", F.lit("]].")).alias("body"))
    return people.unionByName(n.select(F.concat(F.lit("companies/n"), "n_nationkey", F.lit(".md")), F.lit("company"), F.col("n_name"), F.lit("")).toDF("path", "type", "title", "body"))


def relation_answers(spark, sf_dir):
    """Who works, and who used to work, at each nation, by what the people's notes say."""
    notes = cut(_people(spark, sf_dir))
    names = cut(graph.identities(notes, notes.select("path").limit(0)))
    table_ = relations.edges(notes.limit(0).select("path", F.lit("").alias("relation"), F.lit("").alias("target")), notes.select("path", "type"), relations.named_ends(relations.from_prose(notes, "path", "body"), names))
    n = table(spark, sf_dir, "nation")
    asked = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Who currently works at "), "n_name", F.lit("?")).alias("text")).unionByName(n.select((F.col("n_nationkey") + 100).alias("query_id"), F.concat(F.lit("Who used to work at "), "n_name", F.lit("?")).alias("text")))
    return relations.hits(table_, names.withColumnRenamed("target", "path"), relations.requests(asked, "query_id", "text"), types=notes.select("path", "type")).select("query_id", "path")


def overlapping_claims(spark, sf_dir):
    """Excerpts whose path means a scored file of another spelling."""
    claims = table(spark, sf_dir, "code_excerpts").select(F.col("repository").alias("owner"), T.clean_path(F.col("path")).alias("path")).distinct()
    changed = table(spark, sf_dir, "source_records").where("record_id % 100 = 0 AND path IS NOT NULL").select(T.clean_path(F.col("path")).alias("mine")).distinct()
    return routing.overlapping_claims(claims, changed)


QUERIES = {f.__name__: f for f in (graph_fusion, structural_fusion, routed_comment, eligible_entities, relation_answers, overlapping_claims)}

# The source table's relations name symbols as its files declare them; a symbol of one file alone makes an edge.
_REFS = r"""df AS (SELECT DISTINCT repository AS scope, s AS symbol, file FROM (SELECT repository, file, unnest(symbols) AS s FROM src)),
rf AS (SELECT DISTINCT repository AS scope, repository || ':' || regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS src, r.symbol AS symbol FROM (SELECT repository, path, unnest(relations) AS r FROM code_excerpts)),
dp AS (SELECT src, file AS dst, symbol FROM rf JOIN df USING (scope, symbol) JOIN (SELECT scope, symbol FROM df GROUP BY ALL HAVING count(*) <= 1) USING (scope, symbol) WHERE src <> file)"""
_GRAPH = f"""{_CODE}, {_REFS}, e AS (SELECT src, dst, count(*) AS w FROM dp GROUP BY ALL), bo AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY ALL),
fl AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM bo),
sd AS (SELECT cue_id AS query_id, file AS node, score AS amount FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, file) AS r FROM (SELECT cue_id, file, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM carms WHERE ranking <> 'overlap' AND rank <= 10 GROUP BY ALL)) WHERE r <= 15),
{_walk_sql('sd', 'fl', [0.6, 0.36])},
ga AS (SELECT query_id AS cue_id, 'graph' AS ranking, node AS file, row_number() OVER (PARTITION BY query_id ORDER BY round(walk, 12) DESC, node) AS rank FROM wk),
gall AS (SELECT cue_id, ranking, file, rank FROM carms WHERE ranking <> 'overlap' UNION ALL SELECT * FROM ga)"""
_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

ORACLE = {
    "graph_fusion": f"{_GRAPH} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, file) AS rank FROM (SELECT cue_id, file, round(sum(CASE WHEN ranking = 'graph' THEN 0.5 ELSE 1.0 END::DOUBLE / (60 + rank)), 12) AS score FROM gall GROUP BY ALL)) WHERE rank <= {TOP}",
    "structural_fusion": f"""{_GRAPH}, {_SYMBOLS}, sy AS (SELECT cue_id, file, max(score) AS score, arg_max(length, (score, -length)) AS length FROM sc GROUP BY ALL), st AS (SELECT cue_id, 'symbol' AS ranking, file, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, length, file) AS rank FROM sy WHERE score > 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, file) AS rank FROM (SELECT cue_id, file, round(sum(CASE WHEN ranking = 'graph' THEN 0.5 ELSE 1.0 END::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM gall UNION ALL SELECT * FROM st) GROUP BY ALL)) WHERE rank <= {TOP}""",
    "routed_comment": f"""{_CODE}, wt AS (SELECT cue_id, file, round(sum(CASE ranking WHEN 'bm25f' THEN 1.5 ELSE 1.0 END::DOUBLE / (60 + rank)), 12) AS score FROM carms GROUP BY ALL)
SELECT * FROM (SELECT cue_id, w.file, row_number() OVER (PARTITION BY cue_id ORDER BY CASE WHEN b.rank <= 2 THEN b.rank ELSE 1e9 END, score DESC, w.file) AS rank FROM wt w LEFT JOIN (SELECT cue_id, file, rank FROM carms WHERE ranking = 'bm25f') b USING (cue_id, file)) WHERE rank <= {TOP}""",
    "eligible_entities": rf"""WITH {S.NOTES}, i AS (SELECT path, {_W.format("coalesce(title, '')")} AS w FROM notes1), ow AS (SELECT array_to_string(w, ' ') AS identity, min(path) AS path FROM i WHERE len(w) >= 2 GROUP BY 1 HAVING count(DISTINCT path) = 1),
c AS (SELECT note_id AS cue_id, regexp_extract_all('What do we know about ' || coalesce(title, 'it') || ' today?', '[\p{{L}}\p{{N}}]+') AS o FROM notes WHERE note_id % 100 = 0), cw AS (SELECT cue_id, o, list_transform(o, lambda x: lower(x)) AS l FROM c),
pt AS (SELECT path, w, unnest(list_distinct(w)) AS word FROM i), al AS (SELECT word, min(path) AS path, any_value(w) AS own FROM pt WHERE length(word) >= 4 AND word NOT IN ('capital', 'company', 'corp', 'corporation', 'fund', 'group', 'holdings', 'inc', 'labs', 'limited', 'llc', 'ltd', 'meeting', 'partners', 'ventures') GROUP BY word HAVING count(DISTINCT path) = 1),
sa AS (SELECT cue_id, l[k] AS word, list_filter([o[k - 1], o[k + 1]], lambda x: x IS NOT NULL AND regexp_matches(x, '^\p{{Lu}}')) AS near FROM (SELECT cue_id, o, l, unnest(range(1, len(l) + 1)) AS k FROM cw))
SELECT cue_id, path FROM cw JOIN ow ON contains(' ' || array_to_string(l, ' ') || ' ', ' ' || identity || ' ') UNION SELECT cue_id, path FROM sa JOIN al USING (word) WHERE len(list_filter(near, lambda x: NOT list_contains(own, lower(x)))) = 0""",
    "relation_answers": "SELECT n_nationkey + CASE WHEN c_acctbal < 0 THEN 100 ELSE 0 END AS query_id, 'people/c' || c_custkey || '.md' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "overlapping_claims": r"""WITH c AS (SELECT DISTINCT repository AS owner, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path FROM code_excerpts), m AS (SELECT DISTINCT regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS mine FROM source_records WHERE record_id % 100 = 0 AND path IS NOT NULL)
SELECT owner, path, mine FROM c JOIN m ON path = mine OR (contains(mine, '/') AND ends_with(path, '/' || mine)) OR (contains(path, '/') AND ends_with(mine, '/' || path))""",
}
