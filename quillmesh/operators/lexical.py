"""Field-weighted lexical scoring: postings, overlap, BM25F, exact and symbol ranking.

Documents and cues are long tables of (key, field, term). A cue table is small by nature (one row per term of
each cue), the postings are not: the join is left to Catalyst, which broadcasts the cue side only below its own
threshold. Scores combine map-side before they meet by key.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.session import cut, small, spread

# What a match in each field is worth.
OVERLAP_WEIGHTS = {"title": 3.0, "tags": 3.0, "description": 2.0, "headings": 2.0, "body": 1.0}
CODE_WEIGHTS = {"path": 4.0, "symbols": 3.0, "tags": 3.0, "documentation": 2.0, "body": 1.0}
EXACT_WEIGHTS = {"path": 4.0, "symbols": 3.0}
BM25F_WEIGHTS = {"path": 4.0, "title": 3.0, "symbols": 3.0, "tags": 3.0, "description": 2.0, "documentation": 2.0, "headings": 2.0, "body": 1.0}
K1, B, ROUND = 1.2, 0.75, 6


def postings(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, term, tf): how often each term occurs in each field. Null fields have no terms.

    ``key`` is unique, so a row holds all of its document and its terms are counted where it is read: no shuffle,
    and no row per occurrence.
    """
    names = list(fields)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, name, term, n) for name in names for k, text in zip(batch["_k"], batch[name]) for term, n in Counter(T.term_list(text)).items()]
            yield pd.DataFrame(rows, columns=[key, "field", "term", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key).alias("_k"), *(c.alias(name) for name, c in fields.items()))).mapInPandas(count, f"{key} {kind}, field string, term string, tf long")


def profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_terms, n_tokens, digest): how many terms a text has, how many distinct ones, and a hash of them in order."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [T.term_list(t) for t in batch["_t"]]
            digests = [hashlib.md5(" ".join(t).encode()).hexdigest() for t in lists]
            yield pd.DataFrame({key: batch["_k"], "n_terms": [len(t) for t in lists], "n_tokens": [len(set(t)) for t in lists], "digest": digests})

    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(work, f"{key} {kind}, n_terms long, n_tokens long, digest string")


def cue_terms(cues: DataFrame, cue: str, text: str) -> DataFrame:
    """(cue, term, n_terms): the distinct terms of each cue and how many there are, found as the documents' terms are."""
    kind = cues.schema[cue].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, term, len(terms)) for k, t in zip(batch["_k"], batch["_t"]) for terms in [dict.fromkeys(T.term_list(t))] for term in terms]
            yield pd.DataFrame(rows, columns=[cue, "term", "n_terms"])

    return cues.select(F.col(cue).alias("_k"), F.col(text).alias("_t")).mapInPandas(work, f"{cue} {kind}, term string, n_terms long")


def _weight(field: Column, weights: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(field == name, F.lit(w)).otherwise(out)
    return out


def overlap(posts: DataFrame, key: str, cues: DataFrame, cue: str, weights: dict[str, float], mean: bool = True) -> DataFrame:
    """(cue, key, score): summed weights of the fields in which each distinct cue term occurs, over the cue's terms."""
    per = posts.join(cues, "term").groupBy(cue, key).agg(F.sum(_weight(F.col("field"), weights)).alias("s"), F.max("n_terms").alias("n"))
    score = F.round(F.col("s") / F.col("n"), ROUND) if mean else F.round("s", ROUND)
    return per.where("s > 0").select(cue, key, score.alias("score"))


def field_stats(posts: DataFrame, key: str) -> DataFrame:
    """(field, docs, avg_len): documents that have terms in a field, and their mean number of terms there."""
    per = posts.groupBy(key, "field").agg(F.sum("tf").alias("len"))
    return per.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))


def document_frequency(posts: DataFrame, key: str) -> DataFrame:
    """(term, df): documents that hold a term in any field."""
    return posts.groupBy("term", key).agg(F.max("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Distinct terms of a cue set up to which they are sent to the pass that reads the documents.
BROADCAST_TERMS = 1_000_000
#: One row for a document and a term: in which fields it occurs, how often, and how many terms those fields have.
_HITS = "term string, fields array<struct<field: string, tf: bigint, len: bigint>>"


def lookup(docs: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame | None) -> DataFrame:
    """(key, term, fields) of the documents that hold a term of ``terms`` (term), or any term if it is None, and rows
    without a key and term whose ``fields`` add up to the terms of all documents by field.

    Documents are read and split into words once, and only hits leave the pass: no postings are written or
    shuffled for a query. ``key`` is unique. A set of more than BROADCAST_TERMS meets the hits by a join.
    """
    names = list(fields)
    kind = docs.schema[key].dataType.simpleString()
    known = None
    if terms is not None:
        few = [r["term"] for r in terms.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()]
        known = docs.sparkSession.sparkContext.broadcast(frozenset(few)) if len(few) <= BROADCAST_TERMS else None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = known.value if known is not None else None
        for batch in batches:
            rows: list[tuple] = []
            totals = dict.fromkeys(names, (0, 0))
            for k, *texts in zip(batch["_k"], *(batch[n] for n in names)):
                of: dict[str, list[dict]] = {}
                for name, text in zip(names, texts):
                    words = T.term_list(text)
                    if not words:
                        continue
                    size = len(words)
                    totals[name] = (totals[name][0] + 1, totals[name][1] + size)
                    counted = Counter(words) if wanted is None else Counter(w for w in words if w in wanted)
                    for term, n in counted.items():
                        of.setdefault(term, []).append({"field": name, "tf": n, "len": size})
                rows += [(k, term, places) for term, places in of.items()]
            rows.append((None, None, [{"field": n, "tf": d, "len": size} for n, (d, size) in totals.items()]))
            yield pd.DataFrame(rows, columns=[key, "term", "fields"])

    out = spread(docs.select(F.col(key).alias("_k"), *(c.alias(name) for name, c in fields.items()))).mapInPandas(work, f"{key} {kind}, {_HITS}")
    if terms is not None and known is None:
        out = out.where("term IS NULL").unionByName(out.join(terms.select("term").distinct(), "term").select(*out.columns))
    return out


def write_index(docs: DataFrame, key: str, fields: dict[str, Column], name: str, folder: str, buckets: int = 64) -> None:
    """The hits of all terms as a table ``name`` in ``folder``, bucketed and sorted by term, the totals as a small one beside it."""
    found = cut(lookup(docs, key, fields, None))
    found.where("term IS NOT NULL").write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").format("parquet").option("path", f"{folder}/{name}").saveAsTable(name)
    found.where("term IS NULL").write.mode("overwrite").format("parquet").option("path", f"{folder}/{name}_totals").saveAsTable(f"{name}_totals")


def read_index(spark: SparkSession, name: str, terms: DataFrame, literal: int = 400) -> DataFrame:
    """What ``lookup`` gives, from a written index: few terms prune its buckets and row groups, more are joined with it
    bucket by bucket, so the index is not shuffled."""
    wanted = terms.select("term").distinct()
    few = [r["term"] for r in wanted.limit(literal + 1).collect()]
    hits = spark.table(name)
    hits = hits.where(F.col("term").isin(few)) if len(few) <= literal else hits.join(wanted, "term", "left_semi")
    return hits.unionByName(spark.table(f"{name}_totals"))


def bm25f(hits: DataFrame, key: str, n_docs: DataFrame, cues: DataFrame, cue: str, weights: dict[str, float] = BM25F_WEIGHTS, have_all_fields: bool = True) -> DataFrame:
    """(cue, key, score): BM25 over field-weighted, length-normalised term frequencies, from the hits of ``lookup``.

    ``n_docs`` has one row with the number of documents, ``n``. With ``have_all_fields`` an absent field counts
    as an empty one in the mean length, else only documents that have the field do.
    """
    totals = hits.where("term IS NULL").select(F.explode("fields").alias("f")).groupBy("f.field").agg(F.sum("f.tf").alias("having"), F.sum("f.len").alias("total"))
    mean = F.col("total") / (F.col("n") if have_all_fields else F.greatest("having", F.lit(1)))
    means = totals.crossJoin(F.broadcast(n_docs)).agg(F.map_from_entries(F.collect_list(F.struct("field", mean.alias("m")))).alias("_means"), F.max("n").alias("_n"))  # one row
    found = hits.where("term IS NOT NULL")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def part(f: Column) -> Column:
        return _weight(f["field"], weights, 1.0) * f["tf"] / (1 - B + B * f["len"] / F.element_at("_means", f["field"]))

    weighted = found.crossJoin(F.broadcast(means)).select(key, "term", "_n", F.aggregate("fields", F.lit(0.0), lambda acc, f: acc + part(f)).alias("wtf"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    parts = weighted.join(df, "term").select("term", key, (idf * (K1 + 1) * F.col("wtf") / (K1 + F.col("wtf"))).alias("part"))
    return parts.join(cues, "term").groupBy(cue, key).agg(F.round(F.sum("part"), ROUND).alias("score"))


def overlap_hits(hits: DataFrame, key: str, cues: DataFrame, cue: str, weights: dict[str, float], mean: bool = True) -> DataFrame:
    """``overlap`` from the hits of ``lookup``."""
    worth = F.aggregate("fields", F.lit(0.0), lambda acc, f: acc + _weight(f["field"], weights))
    per = hits.where("term IS NOT NULL").select(key, "term", worth.alias("w")).where("w > 0").join(cues, "term").groupBy(cue, key).agg(F.sum("w").alias("s"), F.max("n_terms").alias("n"))
    return per.select(cue, key, (F.round(F.col("s") / F.col("n"), ROUND) if mean else F.round("s", ROUND)).alias("score"))


def ranked(scores: DataFrame, cue: str, key: str, top: int | None = None) -> DataFrame:
    """Adds ``rank``: 1 for the best score of a cue, keys in order where scores tie; only ``top`` are kept if given."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(cue).orderBy(F.col("score").desc(), key)))
    return out.where(F.col("rank") <= top) if top else out


def _holding(texts: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """``texts`` with each ``term`` of ``words`` that its ``text`` contains: an automaton of all terms runs over each text
    once. Terms beyond BROADCAST_TERMS are taken in as many passes as they need."""
    terms = [r["term"] for r in words.select("term").distinct().toLocalIterator()]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    out = None
    for at in range(0, max(1, len(terms)), BROADCAST_TERMS):
        sent = texts.sparkSession.sparkContext.broadcast(terms[at : at + BROADCAST_TERMS])

        def work(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t in sent.value:
                automaton.add_word(t, t)
            automaton.make_automaton()
            for batch in batches:
                held = [sorted({t for _, t in automaton.iter(v)}) if sent.value and v else [] for v in batch[text]]
                yield batch.assign(term=held).explode("term").dropna(subset=["term"])

        part = texts.mapInPandas(work, f"{fields}, term string")
        out = part if out is None else out.unionByName(part)
    return out


def symbol_terms(labels: DataFrame, key: str, label: str, cues: DataFrame, cue: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The terms that cues ask of names: (cue, term, n) and distinct (term); the names (key, name, low); which distinct
    ones (low, files) hold which term; and how rare a term is among all names (term, w)."""
    asked = cues.select(cue, F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: ~(w.rlike("^[a-z]+$") & (F.length(w) <= 2))))).alias("term"))
    asked = asked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(cue)))
    pool = labels.select(key, F.col(label).alias("name"), F.regexp_replace(F.lower(label), r"\(\)$", "").alias("low")).distinct()
    names = pool.groupBy("low").agg(F.count(F.lit(1)).alias("files"))
    total = pool.agg(F.count(F.lit(1)).alias("population"))
    asked = small(asked)
    words = small(asked.select("term").distinct())
    inside = _holding(names, "low", words)
    idf = inside.groupBy("term").agg(F.sum("files").alias("df"))
    rarity = words.join(idf, "term", "left").crossJoin(F.broadcast(total)).select("term", F.log(1 + F.col("population") / (1 + F.coalesce("df", F.lit(0)))).alias("w"))
    return asked, words, pool, inside, rarity


def symbol_scores(labels: DataFrame, key: str, label: str, cues: DataFrame, cue: str, text: str) -> DataFrame:
    """(cue, key, score, length): each file's best definition name for a cue.

    A term scores by its rarity among all names: 1000-fold where it is the name, 100-fold where it begins it,
    once inside it, half where the path holds it; the first two count by the squared share of matched terms.
    Names are compared once per distinct name, not per file.
    """
    asked, words, pool, inside, rarity = symbol_terms(labels, key, label, cues, cue, text)
    tier = F.when(F.col("low") == F.col("term"), 1000.0).when(F.col("low").startswith(F.col("term")), 100.0).otherwise(0.0)
    by_name = inside.join(rarity, "term").join(asked, "term").groupBy(cue, "low").agg(
        F.sum(tier * F.col("w")).alias("tiered"), F.sum(F.when(tier == 0, F.col("w")).otherwise(0.0)).alias("plain"), F.count(F.lit(1)).alias("matched"), F.max("n").alias("n")
    )
    files = pool.select(key).distinct()
    by_path = _holding(files.withColumn("_low", F.lower(key)), "_low", words).drop("_low").join(asked, "term").join(rarity, "term").groupBy(cue, key).agg(F.sum(0.5 * F.col("w")).alias("place"))
    share = F.pow(F.col("matched") / F.col("n"), F.lit(2.0))
    named = by_name.join(pool, "low").select(cue, key, "name", (F.col("plain") + F.when(F.col("tiered") > 0, F.col("tiered") * share).otherwise(0.0)).alias("s"))
    # A file that only its path speaks for has every name at that score; the shortest counts.
    shortest = pool.groupBy(key).agg(F.min(F.length("name")).alias("least"))
    every = named.join(by_path, [cue, key], "full").join(shortest, key)
    scored = every.select(cue, key, F.round(F.coalesce("s", F.lit(0.0)) + F.coalesce("place", F.lit(0.0)), ROUND).alias("score"), F.coalesce(F.length("name"), F.col("least")).cast("long").alias("length"))
    best = scored.groupBy(cue, key).agg(F.max(F.struct(F.col("score"), (-F.col("length")).alias("short"))).alias("b"))
    return best.select(cue, key, F.col("b.score").alias("score"), (-F.col("b.short")).alias("length")).where("score > 0")
