"""Queries over imports, symbol references and the walks over them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.operators import dependencies as D
from quillmesh.operators import graph
from quillmesh.plans import tables
from quillmesh.plans.lexical import _SOURCES
from quillmesh.session import cut, small, snapshot, table

SEED_FILES = 10


def imports_resolve(spark, sf_dir):
    """Which file each import of the record tree means."""
    return D.import_edges(tables.records(spark, sf_dir)).drop("scope")


def _edges(spark, sf_dir):
    return snapshot(spark, sf_dir, "record_edges", lambda: _record_edges(spark, sf_dir))


def _called(calls):
    return calls.select("scope", F.col("file").alias("src"), "at", F.lit("calls").alias("relation"), F.col("target").alias("symbol"))


def _record_edges(spark, sf_dir):
    files = tables.records(spark, sf_dir)
    defined = files.select("scope", F.explode("symbols").alias("symbol"), "file")
    return D.import_edges(files).unionByName(D.symbol_edges(_called(tables.record_calls(spark, sf_dir)), defined, per_file=None))


def _edges_near(spark, sf_dir, near):
    """Those of ``_edges`` that start or end in the files of ``near`` (file): most files are neither joined nor shuffled."""
    files = tables.records(spark, sf_dir)
    defined = files.select("scope", F.explode("symbols").alias("symbol"), "file")
    targets = small(defined.join(near, "file", "left_semi").select(F.col("symbol").alias("target")).distinct())
    calls = cut(_called(tables.record_calls(spark, sf_dir, files=near).unionByName(tables.record_calls(spark, sf_dir, targets=targets))).distinct())
    symbols = small(calls.select("scope", "symbol").distinct())
    return D.import_edges(files, near=near).unionByName(D.symbol_edges(calls, defined.join(symbols, ["scope", "symbol"], "left_semi"), per_file=None))


def dependencies(spark, sf_dir):
    """Files that import a file, or call a symbol that one file alone defines."""
    return _edges(spark, sf_dir).drop("scope")


def ambiguous_dependencies(spark, sf_dir):
    """Names that several files define lead to each of up to five, as ambiguous relations, counted by relation."""
    files = tables.records(spark, sf_dir).where("file LIKE 'erp/%' OR file LIKE 'lib/%'")
    named = table(spark, sf_dir, "part").select(F.expr("concat('erp/parts/p', p_partkey, '.c')").alias("file"), F.expr("concat(p_brand, '/', p_type, '/', p_size)").alias("symbol")).withColumn("scope", F.lit("shop"))
    asked = named.select("scope", F.col("file").alias("src"), F.lit(1).cast("long").alias("at"), F.lit("references").alias("relation"), "symbol")
    found = D.symbol_edges(asked, named, limit=5, per_file=None).unionByName(D.import_edges(files, limit=5))
    return found.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


def dependency_walk(spark, sf_dir):
    """Two steps in both directions from the files of the customers whose key is divisible by 100."""
    anchors = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), F.expr("concat('crm/customers/c', c_custkey, '.js')").alias("node"))
    return D.dependency_ranking(lambda near: cut(D.weighted(_edges_near(spark, sf_dir, near))), anchors, "query_id")


def _order_anchors(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("query_id"), F.expr("concat('shop/orders/o', o_orderkey, '.py')").alias("file"), "o_custkey")


def trace_walk(spark, sf_dir):
    """The same along dependencies only, from the orders whose key is divisible by 100."""
    anchors = _order_anchors(spark, sf_dir).select("query_id", F.col("file").alias("node"))
    return D.dependency_ranking(cut(D.weighted(_edges(spark, sf_dir))), anchors, "query_id", "dependencies")


def symbol_walk(spark, sf_dir):
    """Two hops over symbols from the orders whose key is divisible by 100 and, second, from their customers."""
    orders = _order_anchors(spark, sf_dir)
    first = orders.select("query_id", "file", F.lit(1).alias("rank"))
    second = orders.select("query_id", F.expr("concat('crm/customers/c', o_custkey, '.js')").alias("file"), F.lit(2).alias("rank"))
    calls = cut(tables.record_calls(spark, sf_dir))
    lines = tables.records(spark, sf_dir).select("scope", "file", F.posexplode("symbols").alias("line", "label"))
    return D.symbol_ranking(D.symbol_nodes(lines, calls), calls, first.unionByName(second), "query_id")


def directory_neighborhood(spark, sf_dir):
    """Around the first ten files of each repository whose record id is divisible by 100: themselves, their test
    counterparts, their folders."""
    f = tables.sources(spark, sf_dir)
    order = Window.partitionBy("repository").orderBy("record_id")
    anchors = f.where("record_id % 100 = 0").select("repository", "file", F.row_number().over(order).alias("rank")).where(f"rank <= {SEED_FILES}")
    return D.neighbourhood(f.select(F.col("repository").alias("scope"), "file", "path"), cut(anchors), "repository")


def source_edges(spark, sf_dir):
    """(src, dst, relation, symbol) among the source files, from their imports and the relations of their excerpts."""
    files = tables.sources(spark, sf_dir).select(F.col("repository").alias("scope"), "file", "path", "imports", "symbols")
    said = table(spark, sf_dir, "code_excerpts").select("excerpt_id", F.col("repository").alias("scope"), F.concat("repository", F.lit(":"), tables.T.clean_path(F.col("path"))).alias("src"), F.posexplode("relations").alias("n", "r"))
    asked = said.select("scope", "src", F.col("excerpt_id").alias("at"), F.when(F.col("r.relation") == "imports", "references").otherwise(F.col("r.relation")).alias("relation"), F.col("r.symbol").alias("symbol"))
    return D.import_edges(files).unionByName(D.symbol_edges(asked, files.select("scope", F.explode("symbols").alias("symbol"), "file")))


def source_graph(spark, sf_dir):
    """(a, b, weight, kind): the undirected graph of the source files' dependencies."""
    return snapshot(spark, sf_dir, "source_graph", lambda: _source_graph(spark, sf_dir))


def _source_graph(spark, sf_dir):
    pairs = D.weighted(source_edges(spark, sf_dir))
    return graph.merged(pairs.select("src", "dst", "weight", F.lit("dependency").alias("kind")))


QUERIES = {f.__name__: f for f in (imports_resolve, dependencies, ambiguous_dependencies, dependency_walk, trace_walk, symbol_walk, directory_neighborhood)}

_IMPORTED = """im AS (SELECT 'lib/geo/nations/n' || n_nationkey || '.py' AS src, 'lib/geo/regions/r' || n_regionkey || '.py' AS dst, '..regions.r' || n_regionkey AS symbol FROM nation
UNION ALL SELECT 'crm/customers/c' || c_custkey || '.js', 'lib/geo/nations/n' || c_nationkey || '.py', '../../lib/geo/nations/n' || c_nationkey FROM customer
UNION ALL SELECT 'erp/suppliers/s' || s_suppkey || '.java', 'lib/geo/nations/n' || s_nationkey || '.py', 'geo.nations.n' || s_nationkey FROM supplier
UNION ALL SELECT 'shop/orders/o' || o_orderkey || '.py', 'crm/customers/c' || o_custkey || '.js', 'crm.customers.c' || o_custkey FROM orders)"""
_CALLS = """ca AS (SELECT 'shop/orders/o' || l_orderkey || '.py' AS file, 'Order#' || l_orderkey || '.line' || l_linenumber AS label, unnest([s_name, p_brand]) AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'erp/suppliers/s' || s_suppkey || '.java', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'crm/customers/c' || c_custkey || '.js', c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'lib/geo/nations/n' || n_nationkey || '.py', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_DEFINED = """de AS (SELECT 'lib/geo/regions/r' || r_regionkey || '.py' AS file, r_name AS symbol FROM region UNION ALL SELECT 'lib/geo/nations/n' || n_nationkey || '.py', n_name FROM nation UNION ALL SELECT 'crm/customers/c' || c_custkey || '.js', c_name FROM customer
UNION ALL SELECT 'erp/suppliers/s' || s_suppkey || '.java', s_name FROM supplier UNION ALL SELECT 'erp/parts/p' || p_partkey || '.c', p_brand FROM part UNION ALL SELECT 'shop/orders/o' || o_orderkey || '.py', 'Order#' || o_orderkey FROM orders)"""
_DEPS = f"""{_IMPORTED}, {_CALLS}, {_DEFINED}, ow AS (SELECT symbol, min(file) AS dst FROM de GROUP BY symbol HAVING count(DISTINCT file) = 1),
dp AS (SELECT src, dst, 'imports' AS relation, symbol FROM im UNION ALL SELECT DISTINCT file, dst, 'calls', target FROM ca JOIN ow ON target = symbol WHERE file <> dst)"""


def _walk(seeds: str, pairs: str) -> str:
    flow = f"bo AS (SELECT src, dst, sum(w) AS w FROM ({pairs}) GROUP BY ALL), fl AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM bo)"
    step = lambda last, f: f"SELECT query_id, dst AS node, sum(amount * {f} * share) AS amount FROM {last} JOIN fl ON node = src WHERE amount * {f} * share > 1e-9 GROUP BY ALL"
    return f"WITH {_DEPS}, wp AS (SELECT DISTINCT src, dst, 2.0::DOUBLE AS w FROM dp), {flow}, sd AS ({seeds}), s1 AS ({step('sd', 0.6)}), s2 AS ({step('s1', 0.36)}) SELECT query_id, node, round(sum(amount), 9) AS score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) WHERE (query_id, node) NOT IN (SELECT (query_id, node) FROM sd) GROUP BY ALL"


_FOLDER = r"regexp_extract(p, '^(.*)/[^/]*$', 1)"
_STEM = r"regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches(split_part(p, '/', -1), '.\.[^.]*$') THEN regexp_extract(split_part(p, '/', -1), '^(.+)\.[^.]*$', 1) ELSE split_part(p, '/', -1) END), '^(test|tests)[_.-]+', ''), '[_.-]+(test|tests|spec)$', '')"

ORACLE = {
    "imports_resolve": f"WITH {_IMPORTED} SELECT src, dst, 'imports' AS relation, symbol FROM im",
    "dependencies": f"WITH {_DEPS} SELECT * FROM dp",
    "ambiguous_dependencies": f"""WITH {_IMPORTED}, n AS (SELECT p_partkey AS k, p_brand || '/' || p_type || '/' || p_size AS symbol FROM part), c AS (SELECT symbol, count(*) AS n FROM n GROUP BY symbol)
SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources FROM (SELECT a.k::VARCHAR AS src, 'references_ambiguous' AS relation FROM n a JOIN n b USING (symbol) JOIN c USING (symbol) WHERE a.k <> b.k AND c.n <= 5
UNION ALL SELECT src, 'imports' FROM im WHERE src LIKE 'erp/%' OR src LIKE 'lib/%') GROUP BY relation""",
    "dependency_walk": _walk("SELECT c_custkey AS query_id, 'crm/customers/c' || c_custkey || '.js' AS node, 1.0::DOUBLE AS amount FROM customer WHERE c_custkey % 100 = 0", "SELECT * FROM wp UNION ALL SELECT dst, src, w FROM wp"),
    "trace_walk": _walk("SELECT o_orderkey AS query_id, 'shop/orders/o' || o_orderkey || '.py' AS node, 1.0::DOUBLE AS amount FROM orders WHERE o_orderkey % 100 = 0", "SELECT * FROM wp"),
    "symbol_walk": f"""WITH {_CALLS}, {_DEFINED}, nd AS (SELECT file, symbol AS label FROM de UNION SELECT file, label FROM ca), al AS (SELECT DISTINCT file, label, unnest([label, regexp_extract(label, '([^.]*)$', 1)]) AS target FROM nd),
ac AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY target ORDER BY file, label) <= 51), tg AS (SELECT DISTINCT * FROM ca),
st AS (SELECT tg.file AS f1, tg.label AS l1, ac.file AS f2, ac.label AS l2, min(target) AS target FROM tg JOIN ac USING (target) WHERE NOT (tg.file = ac.file AND tg.label = ac.label) GROUP BY ALL),
sc AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY f1, l1 ORDER BY target, f2, l2) <= 50),
bs AS (SELECT file, label FROM nd LEFT JOIN (SELECT file, label, count(*) AS d FROM tg GROUP BY ALL) USING (file, label) QUALIFY row_number() OVER (PARTITION BY file ORDER BY coalesce(d, 0) DESC, label) = 1),
an AS (SELECT o_orderkey AS q, 'shop/orders/o' || o_orderkey || '.py' AS file, 1 AS r FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT o_orderkey, 'crm/customers/c' || o_custkey || '.js', 2 FROM orders WHERE o_orderkey % 100 = 0),
h0 AS (SELECT q, file, label, 1.0::DOUBLE / r AS s, 0 AS h FROM an JOIN bs USING (file)),
h1 AS (SELECT q, f2 AS file, l2 AS label, max(s) * 0.5 AS s, 1 AS h FROM h0 JOIN sc ON file = f1 AND label = l1 WHERE (q, f2, l2) NOT IN (SELECT (q, file, label) FROM h0) GROUP BY ALL),
h2 AS (SELECT q, f2 AS file, l2 AS label, max(s) / 3 AS s, 2 AS h FROM h1 JOIN sc ON file = f1 AND label = l1 WHERE (q, f2, l2) NOT IN (SELECT (q, file, label) FROM h0 UNION ALL SELECT (q, file, label) FROM h1) GROUP BY ALL)
SELECT q AS query_id, file, round(max(s), 9) AS score, arg_min(h, (-s, h))::BIGINT AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL""",
    "directory_neighborhood": f"""WITH {_SOURCES}, f AS (SELECT repository, file, {_FOLDER} AS folder, {_STEM} AS stem, record_id FROM src), a AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY record_id) AS r FROM f WHERE record_id % 100 = 0 QUALIFY r <= {SEED_FILES}),
s AS (SELECT f.repository, f.file, CASE WHEN f.file = a.file THEN 100.0 WHEN f.stem = a.stem THEN 50.0 ELSE 1.0 END::DOUBLE / r AS score, r FROM f JOIN a ON f.repository = a.repository AND (f.folder = a.folder OR f.stem = a.stem))
SELECT repository, file, round(max(score), 9) AS score, arg_max(r, (score, -r)) AS seed_rank FROM s GROUP BY ALL""",
}
