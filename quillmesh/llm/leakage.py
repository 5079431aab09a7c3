"""Problem 9: held-out passages that appear, fully or partly, in a corpus.

Five-word seeds of the held-out items are looked up in every document in one map-only pass, and how many
documents hold each seed is counted over all of them. Of every few consecutive seeds of an item only the rarest
joins: a document that repeats a run of words holds all seeds of the run, hence the rarest, so no repeat is lost,
while phrases that many documents share join nothing. A Smith-Waterman alignment of words then scores each
distinct passage against each item it shares a rare seed with, edited copies included.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut

SEED_WORDS = 5
#: Every run of so many equal words holds a seed that joins.
COVER_WORDS = 8
#: Consecutive words that make a repetition.
LEAK_WORDS = 12
#: Equal words of an alignment, and their share of its columns, from which it is an edited copy.
EDITED_WORDS, EDITED_IDENTITY = 16, 0.7
#: Rows of (item, place, seed) up to which the seeds are sent to every task; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
#: Cells of an alignment's row over all pairs that are aligned together.
CELLS = 1_000_000

_ODD = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]|!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|\[https?://\S+ ([^\[\]\n]*)\]")
_BLOCK_TAG = re.compile(r"(?i)</?(?:p|br|div|li|ul|ol|td|tr|th|table|h[1-6]|hr|blockquote|pre)\b[^<>]*>")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--.*?-->", re.S)
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?\{")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z]+);")
_MARKS = re.compile(r"(?<=\w)(?:\*{1,3}|_{1,3}|~~|''+|`)(?=\w)")
_HYPHEN = re.compile("(?<=\\w)[-\u2010\u2011](?:[ \\t]*\r?\n\\s*(?:>\\s*)?)?(?=\\w)")
# Scripts written without blanks: each character is a word.
_WIDE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_WIDE}]|[^\W_{_WIDE}]+(?:['’][^\W_{_WIDE}]+)*")
_PLAIN_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words(text: str) -> list[str]:
    """The words of ``text``, without case, punctuation, line breaks (hyphenated ones included) and inline markup."""
    if not text.isascii():
        text = _ODD.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "[" in text:
        text = _LINK.sub(lambda m: m.group(1) or m.group(2) or m.group(3) or "", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "*" in text or "_" in text or "`" in text or "~" in text or "''" in text:
        text = _MARKS.sub("", text)
    if "-" in text or not text.isascii():
        text = _HYPHEN.sub("", text)
    return (_PLAIN_WORD if text.isascii() else _WORD).findall(text.lower())


def _seed(gram: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(gram)) - (1 << 63)


def item_seeds(items: DataFrame, item: str, text: str, size: int = SEED_WORDS) -> DataFrame:
    """(item, item_words, seeds): each item's words, and its seeds in order of place. Items shorter than a seed have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, value in zip(batch["_k"], batch["_t"]):
                w = words(value)
                rows.append((key, " ".join(w), [_seed(w[i : i + size]) for i in range(len(w) - size + 1)]))
            yield pd.DataFrame(rows, columns=[item, "item_words", "seeds"])

    rows = items.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("_k"), F.col(text).alias("_t")).distinct()
    return rows.mapInPandas(work, f"{item} long, item_words string, seeds array<long>")


def _around(w: list[str], hits: list[tuple[int, int]], reach: int, size: int) -> list[tuple[str, list[int], list[int]]]:
    """(words, seeds, seeds not in an earlier one) of the passages of a text around its hits (place, seed)."""
    groups = [[hits[0]]]
    for hit in hits[1:]:
        if hit[0] - groups[-1][-1][0] > reach:
            groups.append([])
        groups[-1].append(hit)
    out, seen = [], set()
    for group in groups:
        held = {s for _, s in group}
        out.append((" ".join(w[max(0, group[0][0] - reach) : group[-1][0] + size + reach]), sorted(held), sorted(held - seen)))
        seen |= held
    return out


_PASSAGE = "passage_words string, seeds array<long>, fresh array<long>"


def _seeded_passages(docs: DataFrame, doc: str, seeds: DataFrame, vocabulary: DataFrame, reach: int, size: int) -> DataFrame:
    """(doc, passage_words, seeds, fresh) around the seeds of each document: map-only, the seeds being few."""
    known = frozenset(r["seed"] for r in seeds.collect())
    sent = docs.sparkSession.sparkContext.broadcast((frozenset(r["word"] for r in vocabulary.collect()), known))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, known = sent.value
        for batch in batches:
            rows = []
            for key, value in zip(batch["_k"], batch["_t"]):
                w = words(value)
                if len(w) < size:
                    continue
                # A seed is a run of `size` words that all occur in some item; few documents have such a run.
                inside = np.fromiter(map(vocabulary.__contains__, w), dtype=np.int8, count=len(w))
                sums = np.cumsum(inside, dtype=np.int32)
                starts = np.flatnonzero(sums[size - 1 :] - np.concatenate(([0], sums[:-size])) == size)
                hits = [(int(i), s) for i in starts if (s := _seed(w[i : i + size])) in known]
                if hits:
                    rows += [(key, *p) for p in _around(w, hits, reach, size)]
            yield pd.DataFrame(rows, columns=[doc, "passage_words", "seeds", "fresh"])

    return docs.mapInPandas(work, f"{doc} long, {_PASSAGE}")


def _joined_passages(docs: DataFrame, doc: str, seeds: DataFrame, reach: int, size: int) -> DataFrame:
    """The same passages for item sets of any size: the documents' seeds meet the items' by a shuffle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, value in zip(batch["_r"], batch["_t"]):
                w = words(value)
                rows += [(key, i, _seed(w[i : i + size])) for i in range(len(w) - size + 1)]
            yield pd.DataFrame(rows, columns=["_r", "at", "seed"])

    def rejoin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *p) for key, t, hits in zip(batch["_k"], batch["_t"], batch["hits"]) for p in _around(words(t), [(h["at"], h["seed"]) for h in hits], reach, size)]
            yield pd.DataFrame(rows, columns=[doc, "passage_words", "seeds", "fresh"])

    rows = docs.withColumn("_r", F.xxhash64("_k", "_t"))
    held = rows.select("_r", "_t").mapInPandas(work, "_r long, at int, seed long").join(seeds, "seed", "left_semi").groupBy("_r").agg(F.array_sort(F.collect_set(F.struct("at", "seed"))).alias("hits"))
    return rows.join(held, "_r").select("_k", "_t", "hits").mapInPandas(rejoin, f"{doc} long, {_PASSAGE}")


def rare_seeds(seeds: DataFrame, df: DataFrame, item: str, size: int = SEED_WORDS, cover: int = COVER_WORDS) -> DataFrame:
    """(item, seed, df): of every ``cover - size + 1`` consecutive seeds (item, at, seed) the rarest that occurs.

    A document with a run of ``cover`` words of the item holds all seeds of the run; so all of them occur, and the
    rarest is among its own.
    """
    w = Window.partitionBy(item).orderBy("at").rangeBetween(0, cover - size)
    least = F.min(F.struct("df", "seed")).over(w).alias("m")
    return seeds.join(df, "seed").select(item, least).select(item, F.col("m.seed").alias("seed"), F.col("m.df").alias("df")).distinct()


def align_all(pairs: list[tuple[list[str], list[str]]], match: int = 2, mismatch: int = -1, gap: int = -1, cells: int = CELLS) -> list[tuple[int, int, int]]:
    """(score, words matched on the best path, longest run of equal words) of each pair's best local alignment.

    Smith-Waterman over many pairs at once: pairs of like size share the rows of one array, so the cost of a
    row is spread over the batch; its memory is bounded by ``cells``, or by one pair. Padding never equals anything.
    """
    ids: dict[str, int] = {}
    code = [tuple(np.array([ids.setdefault(w, len(ids)) for w in side], dtype=np.int32) for side in sorted(pair, key=len)) for pair in pairs]
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(code[i][1]), len(code[i][0])))
    # Score and matches share one integer, so that the matches of the best path come with it.
    unit = 1 << 16
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(code[order[at + n]][1]) <= cells:
            n += 1
        these = order[at : at + n]
        at += n
        rows, cols = max(len(code[i][0]) for i in these), max(len(code[i][1]) for i in these)
        if not rows or not cols:
            continue
        x, y = np.full((len(these), rows), -1, dtype=np.int32), np.full((len(these), cols), -2, dtype=np.int32)
        for k, i in enumerate(these):
            x[k, : len(code[i][0])] = code[i][0]
            y[k, : len(code[i][1])] = code[i][1]
        slope = (-gap * unit * np.arange(cols + 1)).astype(np.int64)
        row, run = np.zeros((len(these), cols + 1), dtype=np.int64), np.zeros((len(these), cols + 1), dtype=np.int32)
        best, longest = np.zeros(len(these), dtype=np.int64), np.zeros(len(these), dtype=np.int32)
        for r in range(rows):
            same = y == x[:, r : r + 1]
            now = np.zeros_like(row)
            np.add(row[:, :-1], np.where(same, match * unit + 1, mismatch * unit), out=now[:, 1:])
            np.maximum(now[:, 1:], row[:, 1:] + gap * unit, out=now[:, 1:])
            now += slope
            np.maximum.accumulate(now, axis=1, out=now)
            now -= slope
            now[now < unit] = 0
            row = now
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            np.maximum(best, row.max(axis=1), out=best)
            np.maximum(longest, run.max(axis=1), out=longest)
        for k, i in enumerate(these):
            out[i] = (int(best[k] // unit), int(best[k] % unit), int(longest[k]))
    return out


def alignments(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, size: int = SEED_WORDS, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc, item, score, matched, longest_run, rarest_df): every document that shares a rare seed with an item, aligned.

    ``score`` is the Smith-Waterman score of the best passage, ``matched`` its equal words, ``longest_run`` the
    most consecutive equal words, ``rarest_df`` in how many documents the pair's rarest seed occurs. Every pair
    with a run of COVER_WORDS equal words is aligned. Null and empty texts share nothing; repeated documents or
    items under other ids are pairs of their own, though their passage is aligned once. Texts shorter than a
    seed have none.
    """
    spark = docs.sparkSession
    given = cut(item_seeds(items, item, item_text, size))
    placed = given.select(item, F.posexplode("seeds").alias("at", "seed"))
    known = placed.select("seed").distinct()
    facts = given.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0)).alias("n"), F.coalesce(F.max(F.size(F.split("item_words", " "))), F.lit(0)).alias("reach")).first()
    rows = docs.where(F.length(text) > 0).select(F.col(doc).cast("long").alias("_k"), F.col(text).alias("_t"))
    small = facts["n"] <= broadcast_seeds
    # An item with seeds has four words more than seeds, so this too is bounded by their number.
    vocabulary = given.where(F.size("seeds") > 0).select(F.explode(F.split("item_words", " ")).alias("word")).distinct()
    passages = cut((_seeded_passages(rows, doc, known, vocabulary, facts["reach"], size) if small else _joined_passages(rows, doc, known, facts["reach"], size)).withColumn("_h", F.md5("passage_words")))
    df = passages.select(doc, F.explode("fresh").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("df"))
    rare = rare_seeds(placed, df, item, size)
    # A text that many documents hold is one passage: copies are aligned once.
    once = passages.dropDuplicates(["_h"]).select("_h", "passage_words", "seeds")
    pairs = once.select("_h", F.explode("seeds").alias("seed")).join(rare, "seed").groupBy("_h", item).agg(F.min("df").alias("rarest_df"))
    full = pairs.join(once.drop("seeds"), "_h").join(given.select(item, "item_words"), item)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = align_all([(p.split(" "), w.split(" ")) for p, w in zip(batch["passage_words"], batch["item_words"])])
            out = pd.DataFrame(got, columns=["score", "matched", "longest_run"], index=batch.index)
            yield pd.concat([batch[["_h", item, "rarest_df"]], out], axis=1)

    # The pairs are few bytes but much work: spread by number, as adaptive execution would join them by size.
    spread = full.select("_h", item, "rarest_df", "passage_words", "item_words").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    scored = spread.mapInPandas(score, f"_h string, {item} long, rarest_df long, score long, matched long, longest_run long")
    best = F.max(F.struct("score", "matched")).alias("_b")
    out = passages.select(doc, "_h").join(scored, "_h").groupBy(doc, item).agg(best, F.max("longest_run").alias("longest_run"), F.min("rarest_df").alias("rarest_df"))
    return out.select(doc, item, "_b.score", "_b.matched", "longest_run", "rarest_df")


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = LEAK_WORDS, **options: int) -> DataFrame:
    """(doc, item, kind, score, matched, longest_run, rarest_df): documents that hold an item's text.

    An alignment counts from the score of ``least`` equal words on. ``kind`` is ``repeat`` where that many stand
    together, else ``edited`` for EDITED_WORDS equal words that make EDITED_IDENTITY of the alignment's columns
    (a column that is not equal costs one point, so the score tells their number); other pairs only resemble.
    """
    pairs = alignments(docs, doc, text, items, item, item_text, **options).where(F.col("score") >= 2 * least)
    identity = F.col("matched") / (3 * F.col("matched") - F.col("score"))
    edited = (F.col("matched") >= EDITED_WORDS) & (identity >= EDITED_IDENTITY)
    kind = F.when(F.col("longest_run") >= least, "repeat").when(edited, "edited")
    return pairs.withColumn("kind", kind).where("kind IS NOT NULL")


def repeated_items(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = LEAK_WORDS) -> DataFrame:
    """(item, doc): documents that repeat at least ``least`` consecutive words of an item: pairs whose alignment reaches
    the score of that many equal words, and then hold them together, by an exact check."""
    return leaks(docs, doc, text, items, item, item_text, least).where("kind = 'repeat'").select(item, doc)
