"""Queries of the subpackage's operators over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import encoding_repair, leakage, markup, packing, pii, score_fusion, secrets, segmentation, source_hygiene, syntax
from quillmesh.session import cut, table

#: Higher is better in all four scores.
SCORES = {"base_score": 1, "personal_score": 1, "association": 1, "co_use": 1}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_fusion.fused_first(table(spark, sf_dir, "code_memory_evidence"), "query_id", "evidence_id", SCORES, "logged_at")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_fusion.fused_ranking(table(spark, sf_dir, "code_memory_evidence"), "query_id", "evidence_id", SCORES, "logged_at")
    return out.withColumn("fused", F.round("fused", 9))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_hygiene.not_handwritten(table(spark, sf_dir, "source_records"), "record_id", "path", "text").select("record_id").distinct()


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = source_hygiene.not_handwritten(table(spark, sf_dir, "source_records"), "record_id", "path", "text")
    return kinds.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("files"), F.count("layout").alias("by_layout"), F.count("notice").alias("by_notice"))


def _pii_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "notes").select(F.lit("notes").alias("src"), F.col("note_id").alias("row_id"), F.col("body").alias("text"))
    events = table(spark, sf_dir, "feedback_events").select(F.lit("feedback_events").alias("src"), F.col("event_id").alias("row_id"), "text")
    return notes.unionByName(events)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _pii_texts(spark, sf_dir)
    return pii.kinds_found(texts, ["src", "row_id"], "text", pii.lexicon_of(pii.distinct_texts(texts, "text"), "text")).distinct()


def p3_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _pii_texts(spark, sf_dir)
    return pii.replaced(texts, ["src", "row_id"], "text", pii.lexicon_of(pii.distinct_texts(texts, "text"), "text")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid(table(spark, sf_dir, "source_records"), "record_id", "path", "text").select("record_id").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(table(spark, sf_dir, "source_records"), "record_id", "repository", "path", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = markup.clean(table(spark, sf_dir, "notes"), "note_id", "path", "body")
    return cleaned.select("note_id", F.explode("kinds").alias("markup")).distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean(table(spark, sf_dir, "notes"), "note_id", "path", "body").withColumn("kinds", F.array_join("kinds", ","))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = secrets.credentials(table(spark, sf_dir, "source_records"), "record_id", "text").select(F.lit("source_records").alias("src"), F.col("record_id").alias("row_id"), "line_no")
    notes = secrets.credentials(table(spark, sf_dir, "notes"), "note_id", "body").select(F.lit("notes").alias("src"), F.col("note_id").alias("row_id"), "line_no")
    return files.unionByName(notes).distinct()


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many credentials of each kind there are, and what their issuers' checksums say where one is public."""
    files = secrets.credentials(table(spark, sf_dir, "source_records"), "record_id", "text").select("kind", "checksum")
    notes = secrets.credentials(table(spark, sf_dir, "notes"), "note_id", "body").select("kind", "checksum")
    return files.unionByName(notes).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("checksum") == "valid").alias("valid"), F.count_if(F.col("checksum") == "invalid").alias("invalid"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = secrets.redacted(table(spark, sf_dir, "source_records"), "record_id", "text").withColumnRenamed("record_id", "row_id").withColumn("src", F.lit("source_records"))
    notes = secrets.redacted(table(spark, sf_dir, "notes"), "note_id", "body").withColumnRenamed("note_id", "row_id").withColumn("src", F.lit("notes"))
    return files.unionByName(notes)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segmentation.pieces(table(spark, sf_dir, "code_excerpts"), "excerpt_id", "text", "start_line")
    return cut.where("piece = 1").select("excerpt_id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.pieces(table(spark, sf_dir, "code_excerpts"), "excerpt_id", "text", "start_line")


def p7_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each excerpt put together again from its pieces without what they share, and whether all of them fit."""
    cut_ = segmentation.pieces(table(spark, sf_dir, "code_excerpts"), "excerpt_id", "text", "start_line")
    whole = cut_.groupBy("excerpt_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start_char", "text"))).alias("ps"), (F.max("tokens") <= segmentation.MAX_TOKENS).alias("fits"))
    text = F.aggregate("ps", F.lit(""), lambda done, p: F.concat(F.left(done, p["start_char"].cast("int")), p["text"]))
    return whole.select("excerpt_id", F.md5(text).alias("digest"), "fits")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")
    return placed.where(F.col("item_tokens") > packing.CAPACITY).select("doc_id").distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document is placed whole, once, in no more pieces than its size asks for, and in containers that hold it."""
    placed = cut(packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text"))
    full = placed.groupBy("container").agg((F.sum("tokens") <= packing.CAPACITY).alias("fits"))
    per = placed.join(full, "container").groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.max("item_tokens").alias("size"), F.count(F.lit(1)).alias("pieces"), F.min("fits").alias("fits"))
    return per.select("doc_id", ((F.col("n") == F.col("size")) & (F.col("pieces") == F.ceil(F.col("size") / packing.CAPACITY))).alias("whole"), "fits")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.repeated_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repaired(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repaired(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_ranking, p2_found, p2_kinds, p3_found, p3_replaced, p4_found, p4_rates, p5_found, p5_clean, p6_found, p6_kinds, p6_redacted,
        p7_found, p7_pieces, p7_rejoined, p8_found, p8_containers, p8_placed, p9_found, p9_leaks, p10_found, p10_repaired,
    )
}

def _first_component() -> str:
    """Problem 1 in SQL: mid-ranks, their correlations, the first component by a hundred steps of power iteration."""
    k = range(len(SCORES))
    clean = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS s{i}" for i, c in enumerate(SCORES))
    shares = ", ".join(
        f"CASE WHEN s{i} IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY query_id ORDER BY s{i} NULLS LAST) + (count(*) OVER (PARTITION BY query_id, s{i}) - 1) / 2.0 - 0.5) / count(s{i}) OVER (PARTITION BY query_id) END AS h{i}" for i in k
    )
    corr = ", ".join(f"coalesce(corr(h{i}, h{j}), 0) AS c{i}{j}" for i in k for j in k if i < j)
    row = lambda i: " + ".join(f"v{j}" if i == j else f"c{min(i, j)}{max(i, j)} * v{j}" for j in k)
    norm = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in k) + ")"
    step = f"SELECT n + 1 AS n, {', '.join(f'w{i} / {norm} AS v{i}' for i in k)} FROM (SELECT n, {', '.join(f'{row(i)} AS w{i}' for i in k)} FROM it, co) WHERE n < 100"
    return f"""WITH RECURSIVE o AS (SELECT query_id, evidence_id, {clean} FROM code_memory_evidence WHERE query_id IS NOT NULL AND evidence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY logged_at DESC) = 1),
sh AS (SELECT query_id, evidence_id, {shares} FROM o), co AS (SELECT {corr} FROM sh), it AS (SELECT 0 AS n, {', '.join(f'1.0::DOUBLE AS v{i}' for i in k)} UNION ALL {step}), ld AS (SELECT * FROM it WHERE n = 100)
SELECT query_id, arg_min(evidence_id, (-round({' + '.join(f'abs(v{i}) * (h{i} - 0.5)' for i in k)}, 9), evidence_id)) AS evidence_id FROM sh, ld GROUP BY query_id"""


ORACLE: dict[str, str] = {
    "p1_found": _first_component(),
    "p7_found": "SELECT DISTINCT excerpt_id FROM code_excerpts WHERE (strlen(text) + 3) // 4 > 800",
    "p7_rejoined": "SELECT excerpt_id, md5(text) AS digest, true AS fits FROM code_excerpts WHERE text IS NOT NULL",
    "p8_placed": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE length(text) > 0",
}
