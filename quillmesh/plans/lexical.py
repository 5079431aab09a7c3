"""Queries over lexical scoring and rank fusion, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import blocks, fusion, held, lexical
from quillmesh.plans import sqltext as S
from quillmesh.plans import tables
from quillmesh.session import cut, small, table

TOP = 10


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes' index, written once: every later step reads it several times."""
    return cut(lexical.postings(tables.notes(spark, sf_dir), "path", tables.note_fields()))


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.cue_terms(tables.note_cues(spark, sf_dir), "cue_id", "text")


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def note_terms(spark, sf_dir):
    return lexical.profile(tables.notes(spark, sf_dir), "path", "body")


def term_df(spark, sf_dir):
    return lexical.document_frequency(_posts(spark, sf_dir), "path")


def field_stats(spark, sf_dir):
    return lexical.field_stats(_posts(spark, sf_dir), "path").withColumn("avg_len", F.round("avg_len", 6))


def overlap_rank(spark, sf_dir):
    """Every note that a cue overlaps, by weighted fields."""
    cues = cut(_cues(spark, sf_dir))
    return lexical.overlap_hits(_note_hits(spark, sf_dir, cues), "path", cues, "cue_id", lexical.OVERLAP_WEIGHTS)


def _note_hits(spark: SparkSession, sf_dir: str, cues: DataFrame) -> DataFrame:
    """Where the notes hold the cues' terms, in one pass over the notes."""
    return cut(lexical.lookup(tables.notes(spark, sf_dir), "path", tables.note_fields(), cues))


_NOTE_ARMS = {"bm25f": blocks.Arm("bm25f", lexical.BM25F_WEIGHTS, bm25=True), "overlap": blocks.Arm("overlap", lexical.OVERLAP_WEIGHTS)}


def bm25f(spark, sf_dir):
    def best(cues: DataFrame) -> DataFrame:
        return blocks.best(blocks.index(tables.notes(spark, sf_dir), "path", tables.note_fields(), cues, "cue_id"), [_NOTE_ARMS["bm25f"]], TOP)

    out = blocks.over(cut(_cues(spark, sf_dir)), "cue_id", best)
    return out.select("cue_id", "path", "score", F.col("rank").cast("long").alias("rank"))


def document_search(spark, sf_dir):
    """The flagship: the ten best documents for every held-out question, by BM25F over titles and texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", F.col("text").alias("body"))
    cues = cut(lexical.cue_terms(table(spark, sf_dir, "eval_items"), "item_id", "text"))
    hits = cut(lexical.lookup(docs, "doc_id", {"title": F.col("title"), "body": F.col("body")}, cues))
    scores = lexical.bm25f(hits, "doc_id", _count(docs), cues, "item_id")
    return lexical.ranked(scores, "item_id", "doc_id", TOP).withColumn("rank", F.col("rank").cast("long"))


_CUE_SOURCE = "(SELECT note_id AS cue_id, concat_ws(' ', title, description) AS text FROM notes WHERE note_id % 100 = 0)"
_NOTE_PRELUDE = f"WITH {S.NOTES}, {S.postings('notes1', 'path', S.NOTE_FIELDS)}"
_N_NOTES = "SELECT count(*) FROM notes1"
_NOTE_BM25 = f"{_NOTE_PRELUDE}, {S.cue_terms(_CUE_SOURCE, 'cue_id', 'text')}, {S.bm25f('posts', 'path', _N_NOTES, 'cues', 'cue_id', lexical.BM25F_WEIGHTS)}"
_NOTE_OVERLAP = f"SELECT cue_id, path, round(sum({S.weight(lexical.OVERLAP_WEIGHTS)}) / max(n_terms), 6) AS score FROM posts JOIN cues USING (term) GROUP BY ALL"


def _note_arms(spark, sf_dir, limit: int) -> DataFrame:
    """(cue_id, ranking, path, rank) of the notes that can be among the best ``limit`` of both rankings fused."""
    arms = list(_NOTE_ARMS.values())

    def front(cues: DataFrame) -> DataFrame:
        ix = blocks.index(tables.notes(spark, sf_dir), "path", tables.note_fields(), cues, "cue_id")
        return blocks.contenders(ix, arms, fusion.contender_depth([1.0] * len(arms), limit))

    return blocks.over(cut(_cues(spark, sf_dir)), "cue_id", front).drop("score")


def rrf(spark, sf_dir):
    """BM25F and overlap, fused."""
    return fusion.fused(_note_arms(spark, sf_dir, TOP), "cue_id", "path", limit=TOP, unique=True).withColumn("rank", F.col("rank").cast("long"))


def protected_fusion(spark, sf_dir):
    arms = _note_arms(spark, sf_dir, TOP + 2)
    out = fusion.protected(arms.where("ranking = 'overlap'"), arms, "cue_id", "path", keep=2, limit=TOP, unique=True)
    return out.withColumn("rank", F.col("rank").cast("long"))


def diverse_protected(spark, sf_dir):
    arms = _note_arms(spark, sf_dir, TOP + 4)
    out = fusion.diverse_protected([arms.where("ranking = 'bm25f'"), arms.where("ranking = 'overlap'")], arms, "cue_id", "path", keep=2, limit=TOP, unique=True)
    return out.withColumn("rank", F.col("rank").cast("long"))


def complete_ranking(spark, sf_dir):
    """Every note for every cue: the overlapping ones by rank, the rest in order of path."""
    asked, cues = tables.note_cues(spark, sf_dir), cut(_cues(spark, sf_dir))
    if known := held.hold(tables.notes(spark, sf_dir), "path", tables.note_fields(), asked, cues, "cue_id", lexical.OVERLAP_WEIGHTS):
        return held.complete(known, spark, "cue_id", "path")
    arms = lexical.ranked(overlap_rank(spark, sf_dir), "cue_id", "path")
    universe = tables.notes(spark, sf_dir).select("path").join(small(asked.select("cue_id")), how="cross")  # a stated query set against all rows
    return fusion.complete(arms, universe, "cue_id", "path").withColumn("rank", F.col("rank").cast("long"))


_ARMS = f"""{_NOTE_BM25}, ov AS ({_NOTE_OVERLAP}),
arms AS (SELECT cue_id, 'bm25f' AS ranking, path, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, path) AS rank FROM bm
UNION ALL SELECT cue_id, 'overlap', path, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, path) FROM ov),
fus AS (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, path) AS rank FROM (SELECT cue_id, path, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM arms GROUP BY ALL))"""


def _code_cues(spark, sf_dir):
    return lexical.cue_terms(tables.code_cues(spark, sf_dir), "cue_id", "text")


_CODE_ARMS = {"bm25f": blocks.Arm("bm25f", lexical.BM25F_WEIGHTS, bm25=True), "exact": blocks.Arm("exact", lexical.EXACT_WEIGHTS, mean=False), "overlap": blocks.Arm("overlap", lexical.CODE_WEIGHTS)}


def _over_code(spark: SparkSession, sf_dir: str, work: Callable[[blocks.Index], DataFrame]) -> DataFrame:
    """``work`` over the source files, of which tests count half."""
    test = T.is_test_source(F.substring_index("file", ":", -1))
    return blocks.over(cut(_code_cues(spark, sf_dir)), "cue_id", lambda cues: work(blocks.index(tables.sources(spark, sf_dir), "file", tables.source_fields(), cues, "cue_id", test)))


def code_arms(spark: SparkSession, sf_dir: str, limit: int, arms: tuple[str, ...] = ("bm25f", "exact"), weights: dict[str, float] | None = None, more: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame:
    """(cue_id, ranking, file, score, rank) of the files that can be among the best ``limit`` of the arms fused, with their
    places in each arm; ``weights`` are those of all rankings to be fused, ``more`` names files that others bring."""
    depth = fusion.contender_depth(list((weights or dict.fromkeys(arms, 1.0)).values()), limit)
    return _over_code(spark, sf_dir, lambda ix: blocks.contenders(ix, [_CODE_ARMS[a] for a in arms], depth, more))


def _code_best(spark: SparkSession, sf_dir: str, arm: str) -> DataFrame:
    out = _over_code(spark, sf_dir, lambda ix: blocks.best(ix, [_CODE_ARMS[arm]], TOP))
    return out.select("cue_id", "file", "score", F.col("rank").cast("long").alias("rank"))


def code_overlap_rank(spark, sf_dir):
    return _code_best(spark, sf_dir, "overlap")


def exact_rank(spark, sf_dir):
    return _code_best(spark, sf_dir, "exact")


def code_bm25f(spark, sf_dir):
    return _code_best(spark, sf_dir, "bm25f")


def lexical_hybrid(spark, sf_dir):
    arms = code_arms(spark, sf_dir, TOP).drop("score")
    return fusion.fused(arms, "cue_id", "file", limit=TOP, unique=True).withColumn("rank", F.col("rank").cast("long"))


def hybrid(spark, sf_dir):
    """The default code search: the best BM25F file stays in front, the rest is fused with the exact ranking."""
    arms = code_arms(spark, sf_dir, TOP + 1).drop("score")
    out = fusion.protected(arms.where("ranking = 'bm25f'"), arms, "cue_id", "file", keep=1, limit=TOP, unique=True)
    return out.withColumn("rank", F.col("rank").cast("long"))


def symbol_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, label): the names that a file defines, and its own."""
    files = tables.sources(spark, sf_dir)
    return files.select("file", F.explode(F.array_union(F.coalesce("symbols", F.array().cast("array<string>")), F.array(T.base_name(F.col("path"))))).alias("label"))


def symbol_rank(spark, sf_dir):
    scores = lexical.symbol_scores(symbol_labels(spark, sf_dir), "file", "label", tables.code_cues(spark, sf_dir), "cue_id", "text")
    return scores.where("score > 0")


_SOURCES = S.SOURCES
_SOURCE_FIELDS = {"path": "p", "symbols": "array_to_string(symbols, ' ')", "documentation": "documentation", "body": "text"}
_CODE_CUE_SOURCE = "(SELECT note_id AS cue_id, title AS text FROM notes WHERE note_id % 100 = 0 AND length(title) > 0)"
_IS_TEST = r"(regexp_matches(lower(split_part(file, ':', 2)), '(^|/)(test|tests|testing|qa|e2e|scenarios|fixtures)/') OR regexp_matches(lower(split_part(file, ':', 2)), '(^|/)(test_[^/]*|[^/]*_test\.py|conftest\.py)$'))"
_HALF = f"CASE WHEN {_IS_TEST} THEN 0.5 ELSE 1.0 END"
_CODE = f"""WITH {_SOURCES}, {S.postings('src', 'file', _SOURCE_FIELDS)}, {S.cue_terms(_CODE_CUE_SOURCE, 'cue_id', 'text')},
{S.bm25f('posts', 'file', 'SELECT count(*) FROM src', 'cues', 'cue_id', lexical.BM25F_WEIGHTS)},
ex AS (SELECT cue_id, file, round(sum({S.weight(lexical.EXACT_WEIGHTS)}), 6) AS score FROM posts JOIN cues USING (term) GROUP BY ALL HAVING sum({S.weight(lexical.EXACT_WEIGHTS)}) > 0),
ov AS (SELECT cue_id, file, round(sum({S.weight(lexical.CODE_WEIGHTS)}) / max(n_terms), 6) AS score FROM posts JOIN cues USING (term) GROUP BY ALL),
scored AS (SELECT cue_id, 'bm25f' AS ranking, file, score * {_HALF} AS score FROM bm UNION ALL SELECT cue_id, 'exact', file, score * {_HALF} FROM ex UNION ALL SELECT cue_id, 'overlap', file, score * {_HALF} FROM ov),
carms AS (SELECT *, row_number() OVER (PARTITION BY cue_id, ranking ORDER BY score DESC, file) AS rank FROM scored),
cfus AS (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, file) AS rank FROM (SELECT cue_id, file, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM carms WHERE ranking <> 'overlap' GROUP BY ALL))"""

QUERIES = {f.__name__: f for f in (document_search, note_terms, term_df, field_stats, overlap_rank, bm25f, rrf, protected_fusion, diverse_protected, complete_ranking, code_overlap_rank, exact_rank, code_bm25f, lexical_hybrid, hybrid, symbol_rank)}

_ASKED = f"""asked AS (SELECT cue_id, unnest(t) AS term, len(t) AS n FROM (SELECT cue_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT (regexp_full_match(w, '[a-z]+') AND length(w) <= 2))) AS t FROM {_CODE_CUE_SOURCE}))"""

_SYMBOLS = f"""pool AS (SELECT DISTINCT file, label AS name, regexp_replace(lower(label), '\\(\\)$', '') AS low FROM (SELECT file, unnest(list_append(coalesce(symbols, []), split_part(p, '/', -1))) AS label FROM src)), {_ASKED},
words AS (SELECT DISTINCT term FROM asked), pop AS (SELECT count(*) AS n FROM pool),
rarity AS (SELECT w.term, ln(1 + (SELECT n FROM pop) / (1.0 + count(p.low))) AS w FROM words w LEFT JOIN pool p ON contains(p.low, w.term) GROUP BY w.term),
cand AS (SELECT a.cue_id, p.file, p.name, a.n, CASE WHEN low = a.term THEN 1000.0 WHEN starts_with(low, a.term) THEN 100.0 ELSE 0.0 END AS tier, contains(low, a.term) AS inside, contains(lower(p.file), a.term) AS place, w
FROM asked a JOIN rarity USING (term) JOIN pool p ON contains(p.low, a.term) OR contains(lower(p.file), a.term)),
byname AS (SELECT cue_id, file, name, sum(CASE WHEN inside THEN tier * w ELSE 0 END) AS tiered, sum(CASE WHEN inside AND tier = 0 THEN w ELSE 0 END) + sum(CASE WHEN place THEN 0.5 * w ELSE 0 END) AS plain, sum(CASE WHEN inside THEN 1 ELSE 0 END) AS matched, max(n) AS n FROM cand GROUP BY ALL),
sc AS (SELECT cue_id, file, length(name) AS length, round(plain + CASE WHEN tiered > 0 THEN tiered * power(matched / n, 2) ELSE 0 END, 6) AS score FROM byname)"""

ORACLE = {
    "document_search": f"""WITH {S.postings('documents', 'doc_id', {'title': 'title', 'body': 'text'})}, {S.cue_terms('eval_items', 'item_id', 'text')}, {S.bm25f('posts', 'doc_id', 'SELECT count(*) FROM documents', 'cues', 'item_id', lexical.BM25F_WEIGHTS)}
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= {TOP}""",
    "note_terms": f"WITH {S.NOTES}, t AS (SELECT path, {S.terms('body')} AS t FROM notes1) SELECT path, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t",
    "term_df": f"{_NOTE_PRELUDE} SELECT term, count(DISTINCT path) AS df FROM posts GROUP BY term",
    "field_stats": f"{_NOTE_PRELUDE} SELECT field, count(*) AS docs, round(avg(len), 6) AS avg_len FROM (SELECT path, field, sum(tf) AS len FROM posts GROUP BY ALL) GROUP BY field",
    "overlap_rank": f"{_NOTE_PRELUDE}, {S.cue_terms(_CUE_SOURCE, 'cue_id', 'text')} {_NOTE_OVERLAP}",
    "bm25f": f"{_NOTE_BM25} SELECT * FROM (SELECT cue_id, path, score, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, path) AS rank FROM bm) WHERE rank <= {TOP}",
    "rrf": f"{_ARMS} SELECT cue_id, path, score, rank FROM fus WHERE rank <= {TOP}",
    "protected_fusion": f"""{_ARMS} SELECT * FROM (SELECT cue_id, path, row_number() OVER (PARTITION BY cue_id ORDER BY CASE WHEN o.rank <= 2 THEN o.rank ELSE 1e9 END, f.rank, path) AS rank
FROM fus f LEFT JOIN (SELECT cue_id, path, rank FROM arms WHERE ranking = 'overlap') o USING (cue_id, path)) WHERE rank <= {TOP}""",
    "diverse_protected": f"""{_ARMS}, a AS (SELECT cue_id, path, rank AS pos FROM arms WHERE ranking = 'bm25f' AND rank <= 2),
b AS (SELECT cue_id, path, 2 + row_number() OVER (PARTITION BY cue_id ORDER BY rank) AS pos FROM arms o WHERE ranking = 'overlap' AND NOT EXISTS (SELECT 1 FROM a WHERE a.cue_id = o.cue_id AND a.path = o.path) QUALIFY row_number() OVER (PARTITION BY cue_id ORDER BY rank) <= 2),
fr AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT * FROM (SELECT cue_id, path, row_number() OVER (PARTITION BY cue_id ORDER BY coalesce(pos, 1e9), f.rank, path) AS rank FROM fus f LEFT JOIN fr USING (cue_id, path)) WHERE rank <= {TOP}""",
    "complete_ranking": f"""{_NOTE_PRELUDE}, {S.cue_terms(_CUE_SOURCE, 'cue_id', 'text')}, ov AS ({_NOTE_OVERLAP})
SELECT c.cue_id, n.path, row_number() OVER (PARTITION BY c.cue_id ORDER BY coalesce(score, -1) DESC, n.path) AS rank FROM (SELECT note_id AS cue_id FROM notes WHERE note_id % 100 = 0) c CROSS JOIN notes1 n LEFT JOIN ov USING (cue_id, path)""",
    "code_overlap_rank": f"{_CODE} SELECT cue_id, file, score, rank FROM carms WHERE ranking = 'overlap' AND rank <= {TOP}",
    "exact_rank": f"{_CODE} SELECT cue_id, file, score, rank FROM carms WHERE ranking = 'exact' AND rank <= {TOP}",
    "code_bm25f": f"{_CODE} SELECT cue_id, file, score, rank FROM carms WHERE ranking = 'bm25f' AND rank <= {TOP}",
    "lexical_hybrid": f"{_CODE} SELECT cue_id, file, score, rank FROM cfus WHERE rank <= {TOP}",
    "hybrid": f"""{_CODE} SELECT * FROM (SELECT cue_id, file, row_number() OVER (PARTITION BY cue_id ORDER BY CASE WHEN b.rank = 1 THEN 1 ELSE 2 END, f.rank) AS rank
FROM cfus f LEFT JOIN (SELECT cue_id, file, rank FROM carms WHERE ranking = 'bm25f') b USING (cue_id, file)) WHERE rank <= {TOP}""",
    "symbol_rank": f"WITH {_SOURCES}, {_SYMBOLS} SELECT cue_id, file, max(score) AS score, arg_max(length, (score, -length))::BIGINT AS length FROM sc GROUP BY ALL",
}
