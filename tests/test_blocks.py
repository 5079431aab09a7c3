"""Rankings of cues over all documents keep to what is asked, and give what scoring all pairs gives."""

import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import blocks, fusion, lexical
from quillmesh.plans import packs
from quillmesh.plans.catalog import QUERIES
from quillmesh.plans.tables import _latest
from quillmesh.session import cut, release, spread

WORDS = ["queue", "planner", "tunnel", "ledger", "shard", "cursor", "beacon", "manifest"]
ARMS = [blocks.Arm("bm25f", lexical.BM25F_WEIGHTS, bm25=True), blocks.Arm("overlap", lexical.OVERLAP_WEIGHTS)]
NOTES = 300


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Notes and source files that every cue meets."""
    folder, at = tmp_path_factory.mktemp("all_meet"), datetime.datetime(2026, 1, 1)
    note = lambda i: (i, f"n/{i * 7919 % 1000:04d}.md", "note", f"{WORDS[i % 8]} queue", "planner", ["tag"], " ".join(WORDS[: 1 + i % 7] * (1 + i % 3)), "active", None, None, False, [], at)
    spark.createDataFrame([note(i) for i in range(1, NOTES + 1)], "note_id long, path string, note_type string, title string, description string, tags array<string>, body string, status string, stale_after string, provenance string, pinned boolean, supersedes array<string>, generated_at timestamp").write.parquet(f"{folder}/notes.parquet")
    file = lambda i: (i, 1, "r", f"{'tests' if i % 5 == 0 else 'src'}/queue_{i * 7919 % 1000:04d}.py", " ".join(WORDS[: 1 + i % 7]), "python", ["queue"], [("queue", 1)], [], "planner", at)
    spark.createDataFrame([file(i) for i in range(1, NOTES + 1)], "record_id long, repo_id long, repository string, path string, text string, lang string, symbols array<string>, symbol_locations array<struct<symbol: string, line: int>>, imports array<string>, documentation string, indexed_at timestamp").write.parquet(f"{folder}/source_records.parquet")
    spark.createDataFrame([], "excerpt_id long, record_id long, repository string, path string, start_line int, end_line int, text string, arms array<struct<arm: string, rank: int>>, relations array<struct<relation: string, symbol: string, provenance: string, target_line: int>>").write.parquet(f"{folder}/code_excerpts.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["bm25f", "rrf", "hybrid", "goal_relevance", "facet_recall", "code_pack", "code_excerpt", "lexical_hybrid", "diverse_protected", "protected_fusion", "routed_comment", "code_bm25f", "graph_fusion"])
def test_pairs_of_cues_and_documents_are_not_made(spark, tables, name, monkeypatch):
    def product(*_, **__):
        raise AssertionError("scores of all pairs")

    monkeypatch.setattr(lexical, "bm25f", product)
    monkeypatch.setattr(lexical, "overlap_hits", product)
    assert QUERIES[name](spark, tables).count() > 0


def test_places_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 40)
    monkeypatch.setattr(blocks, "SENT_KEYS", 50)
    docs = spark.createDataFrame([(f"k{i * 37 % 300:03d}", WORDS[i % 8], " ".join(WORDS[: i % 9] * (i % 4)) or None) for i in range(300)], "key string, title string, body string").repartition(3)
    cues = spark.createDataFrame([(c, t, 3) for c in range(4) for t in (WORDS[c], WORDS[c + 1], "nowhere")], "cue long, term string, n_terms long")
    fields = {"title": F.col("title"), "body": F.col("body")}
    hits = lexical.lookup(docs, "key", fields, cues)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    every = [lexical.ranked(lexical.bm25f(hits, "key", n, cues, "cue"), "cue", "key"), lexical.ranked(lexical.overlap_hits(hits, "key", cues, "cue", lexical.OVERLAP_WEIGHTS), "cue", "key")]
    want = {(r["cue"], a.name, r["key"]): (r["score"], r["rank"]) for a, df in zip(ARMS, every) for r in df.collect()}
    ix = blocks.index(docs, "key", fields, cues, "cue")
    got = {(r["cue"], r["ranking"], r["key"]): (r["score"], r["rank"]) for r in blocks.best(ix, ARMS, 7).collect()}
    assert got == {k: v for k, v in want.items() if v[1] <= 7}
    more = spark.createDataFrame([(0, "k001"), (1, "k299"), (2, "none")], "cue long, key string")
    got = {(r["cue"], r["ranking"], r["key"]): (r["score"], r["rank"]) for r in blocks.contenders(ix, ARMS, 5, lambda front: more).collect()}
    front = {(c, k) for (c, _, k), (_, rank) in want.items() if rank <= 5} | {(0, "k001"), (1, "k299")}
    assert got == {k: v for k, v in want.items() if (k[0], k[2]) in front}
    every = every[0].withColumn("ranking", F.lit("bm25f")).unionByName(every[1].withColumn("ranking", F.lit("overlap")))
    whole = fusion.fused(every, "cue", "key", limit=5, unique=True).collect()
    depth = fusion.contender_depth([1.0, 1.0], 5)
    assert sorted(fusion.fused(blocks.contenders(ix, ARMS, depth), "cue", "key", limit=5, unique=True).collect()) == sorted(whole)


def _docs_and_cues(spark):
    docs = spark.createDataFrame([(f"k{i * 37 % 300:03d}", WORDS[i % 8], " ".join(WORDS[: i % 9] * (i % 4)) or None, i % 5 == 0) for i in range(300)], "key string, title string, body string, half boolean")
    cues = spark.createDataFrame([(c, t, 3) for c in range(4) for t in (WORDS[c], WORDS[c + 1], "nowhere")], "cue long, term string, n_terms long")
    return docs, {"title": F.col("title"), "body": F.col("body")}, cues


@pytest.mark.parametrize("order", ["half", "size(ids)"])
def test_a_block_lets_out_nothing_behind_the_front(spark, monkeypatch, order):
    """The leaders of many blocks are fewer than the front of each block, and the front of all is among them, also where it
    lies in one block and scores are equal."""
    docs, fields, cues = _docs_and_cues(spark)
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 20)
    monkeypatch.setattr(blocks, "FEW", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        ix = blocks.index(docs, "key", fields, cues, "cue", F.col("half"))
        ix = ix._replace(rows=ix.rows.coalesce(1).sortWithinPartitions(F.expr(order)))
        bounded = cut(blocks._leaders(ix, ARMS, 12))
        monkeypatch.setattr(blocks, "FEW", 12)
        whole = cut(blocks._leaders(ix, ARMS, 12))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(blocks._ranked(ix, bounded, ARMS, 12).collect()) == sorted(blocks._ranked(ix, whole, ARMS, 12).collect())
    assert bounded.count() < whole.count() / 3


def test_a_place_leaves_a_task_as_a_number(spark):
    """Neither the names of what is placed nor a count of every block are shuffled."""
    docs, fields, cues = _docs_and_cues(spark)
    ix = blocks.index(docs.repartition(3), "key", fields, cues, "cue")
    plan = blocks.placed(ix, ARMS, blocks._leaders(ix, ARMS, 5))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(at#" in plan and "hashpartitioning(cue#" not in plan


@pytest.mark.parametrize("name", ["hybrid", "protected_fusion", "diverse_protected", "code_pack", "code_excerpt", "graph_fusion", "routed_comment", "lexical_hybrid", "code_bm25f", "goal_relevance"])
def test_texts_stay_where_they_are_read(spark, tables, name, monkeypatch):
    """Tables in files enough for all cores are neither shuffled for their latest rows nor spread."""

    def shuffled(*_):
        raise AssertionError("texts are shuffled")

    release(spark)
    monkeypatch.setattr(DataFrame, "repartition", shuffled)
    assert QUERIES[name](spark, tables).count() > 0


def test_only_keys_are_shuffled_for_the_latest_rows(spark):
    """What stays of each path is found by the keys; a copy that nothing tells from what stays is dropped nevertheless."""
    rows = spark.createDataFrame([("a", 1, 1, "old"), ("a", 2, 1, "low"), ("a", 2, 2, "new"), (None, None, 5, "none"), (None, 1, 4, "some"), ("b", 1, 1, "only")], "path string, at long, id long, body string")
    kept = _latest(rows, ["path"], "at", "id")
    assert sorted(r["body"] for r in kept.collect()) == ["new", "only", "some"]
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["body"] for r in _latest(rows.union(rows), ["path"], "at", "id").collect()) == ["new", "only", "some"]
    many = cut(spark.range(1000).repartition(spark.sparkContext.defaultParallelism))
    assert "Exchange" not in spread(many)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in spread(cut(spark.range(1000).coalesce(1)))._jdf.queryExecution().executedPlan().toString()


def test_only_the_texts_of_chosen_files_are_joined(spark, tables):
    chosen = spark.createDataFrame([(1, "r:src/queue_0919.py"), (2, "r:src/queue_0919.py")], "cue_id long, file string")
    texts = packs._texts(spark, tables, chosen)
    assert [r["file"] for r in texts.collect()] == ["r:src/queue_0919.py"]
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_halves_are_rounded_up():
    assert blocks.units(blocks.np.array([0.0078125, 0.0000005, 1.0000004, 2.5])).tolist() == [7813, 1, 1000000, 2500000]


def test_a_block_holds_lengths_by_document():
    """Two documents with three hits each: what a hit is worth comes from its document's lengths, held once."""
    batch = pa.RecordBatch.from_pydict({"key": ["b", "a"], "half": [False, True], "ids": [[0, 1, 2], [2, 1, 0]], "tfs": [[1, 0, 0, 2, 1, 1], [0, 1, 2, 0, 0, 3]], "lens": [[4, 10], [2, 30]]}, pa.schema([("key", pa.string()), ("half", pa.bool_()), *((c, pa.list_(pa.int32())) for c in ("ids", "tfs", "lens"))]))
    known = {"fields": ["title", "body"], "terms": [np.array([0, 2])], "sizes": [2], "df": np.full(3, 2.0), "means": np.array([3.0, 20.0]), "n": 2}
    block = blocks._Block([batch], known)
    assert block.keys == ["a", "b"] == block.arrow.to_pylist() and block.lens.tolist() == [[2, 30], [4, 10]]
    assert block.sums(ARMS[1], known["terms"][0]).tolist() == [1.0 + 1.0, 3.0 + 4.0]
    parts = lambda tf, n, mean, w: w * tf / (1 - lexical.B + lexical.B * n / mean)
    wtf = np.array([parts(3, 30, 20, 1.0), parts(1, 30, 20, 1.0)]), np.array([parts(1, 4, 3, 3.0), parts(1, 4, 3, 3.0) + parts(1, 10, 20, 1.0)])
    idf = np.log(1 + 0.5 / 2.5)
    assert np.allclose(block.sums(ARMS[0], known["terms"][0]), [sum(idf * (lexical.K1 + 1) * w / (lexical.K1 + w)) for w in wtf])
