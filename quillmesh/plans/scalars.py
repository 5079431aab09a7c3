"""Queries over predicates and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import lexical, notebook, routing
from quillmesh.plans import sqltext as S
from quillmesh.plans import tables
from quillmesh.session import cut, small, snapshot, table

TODAY = "2026-06-30"


def slugs(spark, sf_dir):
    """File names of all notes, and the number a repeated one gets in order of path."""
    n = tables.notes(spark, sf_dir).select("path", T.slug(F.col("title"), 24).alias("slug"))
    again = Window.partitionBy("slug").orderBy("path")
    return n.withColumn("n", F.row_number().over(again).cast("long"))


def scrub(spark, sf_dir):
    d = table(spark, sf_dir, "notes").where("body IS NOT NULL").select("note_id", "body", T.scrub(F.col("body")).alias("clean"))
    return d.where("body <> clean").select("note_id", F.md5("clean").alias("digest"), F.length("clean").cast("long").alias("length"))


def clips(spark, sf_dir):
    b = F.coalesce(F.col("body"), F.lit(""))
    return table(spark, sf_dir, "notes").select("note_id", T.clip_words(b, 60).alias("words"), T.short_line(b, 60).alias("line"), T.truncate_lines(b, 30).alias("lines"))


def token_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "code_excerpts").where("text IS NOT NULL")
    return d.select("excerpt_id", T.estimate_tokens(F.col("text")).alias("prose"), T.estimate_code_tokens(F.col("text")).alias("code"))


def test_paths(spark, sf_dir):
    p = T.clean_path(F.col("path"))
    return table(spark, sf_dir, "source_records").select("record_id", T.is_test_source(p).alias("source_rule"), T.is_test_note(p).alias("note_rule"))


def name_tokens(spark, sf_dir):
    t = F.coalesce(F.col("title"), F.lit(""))
    return table(spark, sf_dir, "notes").select("note_id", T.normal_name(t).alias("name"), T.link_safe(t).alias("safe"), T.relation_token(t).alias("relation"))


def code_keys(spark, sf_dir):
    """Keys of all scored files, and whether they are those that were logged."""
    d = table(spark, sf_dir, "code_memory_evidence").select("repository", "path", "code_key").distinct()
    key = T.code_key(F.col("repository"), F.col("path"))
    return d.select("repository", "path", key.alias("key"), (key == F.col("code_key")).alias("same"), T.directory(T.clean_path(F.col("path"))).alias("folder"), T.stem_name(T.clean_path(F.col("path"))).alias("stem"))


def stale_notes(spark, sf_dir):
    return tables.notes(spark, sf_dir).where(T.is_stale(F.col("stale_after"), TODAY)).select("path", "stale_after")


def lifecycle(spark, sf_dir):
    """Notes by status in one spelling; a missing one is stable."""
    status = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("stable"))
    return tables.notes(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("pinned", F.lit(False))).alias("pinned"))


def superseded(spark, sf_dir):
    """Paths that another note replaces or that are deprecated."""
    return snapshot(spark, sf_dir, "superseded", lambda: _superseded(spark, sf_dir))


def _superseded(spark, sf_dir):
    n = tables.notes(spark, sf_dir)
    named = n.select(F.explode("supersedes").alias("path"))
    deprecated = n.where(F.lower(F.trim("status")) == "deprecated").select("path")
    return named.unionByName(deprecated).distinct().join(n.select("path"), "path", "left_semi")


def current_notes(spark, sf_dir):
    return tables.notes(spark, sf_dir).select("path", "title").join(superseded(spark, sf_dir), "path", "left_anti")


def aligned_fields():
    """What a note says, whole and outside addresses."""
    whole = F.concat_ws(" ", "title", F.array_join("tags", " "), "description", "body")
    return {"all": whole, "plain": F.array_join(F.filter(F.split(whole, r"\s+"), lambda w: ~w.contains("/") & ~F.lower(w).startswith("www.")), " ")}


def goal_alignment(spark, sf_dir):
    """Notes that a goal (the title of a pinned note whose id is divisible by 100) is about: two terms in common, or
    one that stands outside addresses."""
    goals = table(spark, sf_dir, "notes").where("note_id % 100 = 0 AND length(title) > 0").select(F.col("note_id").alias("goal_id"), "title")
    terms = cut(lexical.cue_terms(goals, "goal_id", "title"))
    hits = lexical.lookup(tables.notes(spark, sf_dir), "path", aligned_fields(), terms).where("term IS NOT NULL").join(terms, "term")  # by term, not all against all
    per = hits.groupBy("goal_id", "path").agg(F.count_if(F.exists("fields", lambda f: f["field"] == "all")).alias("matched"), F.count_if(F.exists("fields", lambda f: f["field"] == "plain")).alias("outside"))
    return per.where("matched >= 2 OR outside >= 1").select("goal_id", "path", "matched")


def cosine_topk(spark, sf_dir):
    """The ten nearest vectors of each queried one (ids divisible by 100), above the floor of 0.3 first."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = e.join(small(q, 2_000), F.col("vec_id") != F.col("query_id"))  # a stated query set against all rows
    scored = pairs.select("query_id", "vec_id", F.round(T.cosine(F.col("q"), F.col("embedding")), 6).alias("cosine"))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")).cast("long"))
    return scored.where("rank <= 10")


def query_routes(spark, sf_dir):
    """The route of each question: its kind tells the parts that a tool would send with it."""
    parts = {"ops": ["command", "failure_excerpt"], "link": ["anchor_file", "anchor_diff"], "correction": ["review_comment", "path"], "pinned": ["changed_file"]}
    sent = F.array().cast("array<string>")
    for kind, names in parts.items():
        sent = F.when(F.col("kind") == kind, F.array(*map(F.lit, names))).otherwise(sent)
    return table(spark, sf_dir, "eval_items").groupBy(routing.route_of(sent).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def note_types(spark, sf_dir):
    """Types as notes declare them or their folders tell, and how long each has been stale."""
    n = tables.notes(spark, sf_dir)
    late = F.unix_timestamp(F.lit(TODAY), "yyyy-MM-dd") - F.unix_timestamp(F.try_to_timestamp(F.left("stale_after", F.lit(10)), F.lit("yyyy-MM-dd")))
    return n.select("path", T.note_type(F.when(F.col("note_id") % 2 == 0, F.col("note_type")), F.col("path")).alias("type"), F.when(late > 0, T.age(late)).alias("stale_for"), T.ledger_path(F.regexp_replace("path", r"\.md$", "")).alias("key"))


def observed_notes(spark, sf_dir):
    """Which source file each excerpt's path means, seen from another checkout; a file stands for a note of its path."""
    files = tables.sources(spark, sf_dir).select(F.col("file").alias("path"), F.col("path").alias("resource"))
    seen = table(spark, sf_dir, "code_excerpts").select("excerpt_id", F.concat(F.lit("/home/x/checkout/"), T.clean_path(F.col("path"))).alias("seen"))
    return notebook.observed_notes(seen, "excerpt_id", "seen", files)


def notes_from_graph(spark, sf_dir):
    """Source files' symbols as notes with the other symbols of their file as connections."""
    f = tables.sources(spark, sf_dir).select("record_id", "file", F.posexplode("symbols").alias("i", "label")).withColumn("id", F.concat_ws("#", "file", "label"))
    nodes = f.groupBy("id").agg(F.min("record_id").alias("ordinal"), F.first("label").alias("label")).withColumn("folder", F.lit("code")).withColumn("body", F.lit(""))
    other = f.select("file", F.col("id").alias("target"), F.col("i").alias("n"))
    links = f.where("i = 0").select("file", F.col("id").alias("source")).distinct().join(other, "file").where("source <> target").select("source", "target", F.lit("defined with").alias("relation"), F.lit("extracted").alias("confidence"), "n").distinct()
    made = notebook.notes_from_graph(nodes, links, tables.notes(spark, sf_dir).select("path", "title", "provenance", "body"))
    return made.select("id", "path", "state", F.md5("body").alias("digest"))


QUERIES = {f.__name__: f for f in (slugs, scrub, clips, token_estimates, test_paths, name_tokens, code_keys, stale_notes, lifecycle, superseded, current_notes, goal_alignment, cosine_topk, query_routes, note_types, observed_notes, notes_from_graph)}

_SUPERSEDED = f"WITH {S.NOTES}, sup AS (SELECT DISTINCT path FROM (SELECT unnest(supersedes) AS path FROM notes1 UNION ALL SELECT path FROM notes1 WHERE lower(trim(status)) = 'deprecated') WHERE path IN (SELECT path FROM notes1))"
_P = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"
_TF = "test|tests|testing|qa|e2e|scenarios|fixtures"
_NTF = "test|tests|spec|specs|testdata|testing|__tests__|test_apps|fixtures|qa|scenarios|e2e"
_SLUG = "trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')"
_WHOLE = "concat_ws(' ', title, array_to_string(tags, ' '), description, body)"
_SAFE = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(title, ''), '[\x00-\x1f\x7f]+', ' ', 'g')), '[\[\]|#()]', ' ', 'g'), '\s+', ' ', 'g'))"

ORACLE = {
    "slugs": f"""WITH {S.NOTES}, s AS (SELECT path, {_SLUG} AS s FROM notes1), t AS (SELECT path, CASE WHEN title_null THEN 'unnamed' ELSE slug END AS slug FROM
(SELECT path, s IS NULL AS title_null, CASE WHEN s = '' THEN 'unnamed' WHEN length(s) > 24 THEN rtrim(left(s, 24), '-') || '-' || left(sha256(s), 8) ELSE s END AS slug FROM s))
SELECT path, slug, row_number() OVER (PARTITION BY slug ORDER BY path) AS n FROM t""",
    "scrub": r"""WITH c AS (SELECT note_id, body, regexp_replace(body, '(sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{12,}|xox[bap]-[A-Za-z0-9-]{10,}|(?:password|passwd|secret|token|api_key|apikey)\s*[=:]\s*\S+)', '[scrubbed]', 'gi') AS clean FROM notes WHERE body IS NOT NULL)
SELECT note_id, md5(clean) AS digest, length(clean) AS length FROM c WHERE body <> clean""",
    "clips": r"""WITH b AS (SELECT note_id, coalesce(body, '') AS b, trim(coalesce(body, '')) AS t, trim(regexp_replace(coalesce(body, ''), '\s+', ' ', 'g')) AS l FROM notes),
c AS (SELECT *, rtrim(regexp_extract(left(t, 60), '(?s)^(.*\S)\s+\S*$', 1), ' ,;:.-') AS cut, left(b, 104) AS head FROM b)
SELECT note_id, CASE WHEN length(t) <= 60 THEN t ELSE CASE WHEN cut = '' THEN left(t, 60) ELSE cut END || ' …' END AS words,
CASE WHEN length(l) <= 60 THEN l ELSE rtrim(left(l, 59)) || '…' END AS line,
CASE WHEN length(b) <= 120 THEN b ELSE CASE WHEN contains(head, chr(10)) THEN regexp_extract(head, '(?s)^(.*)\n[^\n]*$', 1) ELSE head END || chr(10) || '[... truncated]' END AS lines FROM c""",
    "token_estimates": "SELECT excerpt_id, greatest(1, length(text) // 4)::BIGINT AS prose, ((strlen(text) + 3) // 4)::BIGINT AS code FROM code_excerpts WHERE text IS NOT NULL",
    "test_paths": f"""SELECT record_id, regexp_matches(lower(p), '(^|/)({_TF})/') OR regexp_matches(lower(p), '(^|/)(test_[^/]*|[^/]*_test\\.py|conftest\\.py)$') AS source_rule,
regexp_matches(lower(p), '(^|/)({_NTF})/') OR regexp_matches(st, '(Test|Tests|TestCase|Spec)$') OR regexp_full_match(lower(st), 'test[_-].*|test|.*[_-](test|tests|spec)') OR contains(lower(nm), '.test.') OR contains(lower(nm), '.spec.') AS note_rule
FROM (SELECT record_id, p, nm, CASE WHEN regexp_matches(nm, '.\\.[^.]*$') THEN regexp_extract(nm, '^(.+)\\.[^.]*$', 1) ELSE nm END AS st FROM (SELECT record_id, {_P} AS p, split_part({_P}, '/', -1) AS nm FROM source_records))""",
    "name_tokens": rf"""SELECT note_id, lower(regexp_replace(trim(coalesce(title, '')), '\s+', ' ', 'g')) AS name, {_SAFE} AS safe, CASE WHEN r = '' THEN 'relates_to' ELSE r END AS relation FROM (SELECT *, trim(lower(regexp_replace({_SAFE}, '\s+', '_', 'g')), '_') AS r FROM notes)""",
    "code_keys": f"""SELECT DISTINCT repository, path, 'code:' || left(sha256(lower(repository)), 20) || ':' || {_P} AS key, code_key = 'code:' || left(sha256(lower(repository)), 20) || ':' || {_P} AS same, regexp_extract({_P}, '^(.*)/[^/]*$', 1) AS folder,
regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches(split_part({_P}, '/', -1), '.\\.[^.]*$') THEN regexp_extract(split_part({_P}, '/', -1), '^(.+)\\.[^.]*$', 1) ELSE split_part({_P}, '/', -1) END), '^(test|tests)[_.-]+', ''), '[_.-]+(test|tests|spec)$', '') AS stem FROM code_memory_evidence""",
    "stale_notes": f"WITH {S.NOTES} SELECT path, stale_after FROM notes1 WHERE '{TODAY}' >= left(stale_after, 10)",
    "lifecycle": f"WITH {S.NOTES} SELECT coalesce(nullif(lower(trim(status)), ''), 'stable') AS status, count(*) AS n, count_if(coalesce(pinned, false))::BIGINT AS pinned FROM notes1 GROUP BY 1",
    "superseded": f"{_SUPERSEDED} SELECT path FROM sup",
    "current_notes": f"{_SUPERSEDED} SELECT path, title FROM notes1 WHERE path NOT IN (SELECT path FROM sup)",
    "goal_alignment": f"""WITH {S.NOTES}, g AS (SELECT note_id AS goal_id, unnest(list_distinct({S.terms('title')})) AS term FROM notes WHERE note_id % 100 = 0 AND length(title) > 0),
d AS (SELECT path, list_distinct({S.terms(_WHOLE)}) AS al, list_distinct({S.terms("array_to_string(list_filter(regexp_split_to_array(" + _WHOLE + ", '[ \t\n\r\f\x0b]+'), lambda w: NOT contains(w, '/') AND NOT starts_with(lower(w), 'www.')), ' ')")}) AS pl FROM notes1),
h AS (SELECT path, unnest(al) AS term, pl FROM d)
SELECT goal_id, path, count(*) AS matched FROM h JOIN g USING (term) GROUP BY ALL HAVING count(*) >= 2 OR count_if(list_contains(pl, term)) >= 1""",
    "cosine_topk": """SELECT * FROM (SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
    "query_routes": "SELECT CASE kind WHEN 'ops' THEN 'trace' WHEN 'link' THEN 'ripple' WHEN 'correction' THEN 'comment' WHEN 'pinned' THEN 'code' ELSE 'general' END AS route, count(*) AS n FROM eval_items GROUP BY 1",
    "note_types": f"""WITH {S.NOTES} SELECT path, coalesce(nullif(lower(trim(CASE WHEN note_id % 2 = 0 THEN note_type END)), ''), CASE lower(split_part(path, '/', 1)) WHEN 'people' THEN 'person' WHEN 'companies' THEN 'company' WHEN 'funds' THEN 'fund' WHEN 'meetings' THEN 'meeting' ELSE '' END) AS type,
CASE WHEN left(stale_after, 10) < '{TODAY}' THEN datediff('day', left(stale_after, 10)::DATE, DATE '{TODAY}') || 'd' END AS stale_for, path AS key FROM notes1""",
    "observed_notes": rf"""WITH {S.SOURCES}, r AS (SELECT p, min(file) AS file FROM src GROUP BY p), x AS (SELECT excerpt_id, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS p FROM code_excerpts)
SELECT excerpt_id, file AS path FROM x JOIN r ON contains(r.p, '/') AND (x.p = r.p OR ends_with(x.p, '/' || r.p)) QUALIFY row_number() OVER (PARTITION BY excerpt_id ORDER BY length(r.p) DESC, r.p) = 1""",
    "notes_from_graph": f"""WITH {S.SOURCES}, f AS (SELECT record_id, file, unnest(range(1, len(symbols) + 1)) - 1 AS i, symbols FROM src), g AS (SELECT record_id, file, i, symbols[i + 1] AS label, file || '#' || symbols[i + 1] AS id FROM f),
nd AS (SELECT id, min(record_id) AS o, any_value(label) AS label FROM g GROUP BY id), sl AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unnamed') AS s FROM nd),
pa AS (SELECT id, label, 'code/' || s || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS path FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o, id) AS n FROM sl)), am AS (SELECT lower(label) AS k FROM pa GROUP BY 1 HAVING count(*) > 1),
li AS (SELECT DISTINCT a.id AS source, b.id AS target, b.i AS n FROM g a JOIN g b USING (file) WHERE a.i = 0 AND a.id <> b.id), ln AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n, target) AS r, '- defined with [[' || CASE WHEN lower(p.label) IN (SELECT k FROM am) THEN p.path || '|' || p.label ELSE p.label END || ']] (extracted)' AS line FROM li JOIN pa p ON target = id),
bd AS (SELECT source, '## Connections' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY r) AS body FROM ln WHERE r <= 30 GROUP BY source)
SELECT id, path, 'new' AS state, md5(coalesce(body, label)) AS digest FROM pa LEFT JOIN bd ON source = id""",
}
