"""Problem 8: texts into containers of fixed token capacity.

Shortest-pack-first histogram packing: only the number of texts of each length reaches the driver (at most
``capacity`` integers, whatever the corpus), the packing is worked out on that histogram, and the resulting
patterns are joined back to the texts by their rank within their length.
"""

from __future__ import annotations

import base64
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut

CAPACITY = 8192
#: Name of a vocabulary in the public tokenizer package, or a path to a file of that format.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Texts of one length that one task numbers; longer runs are spread over more tasks.
ROWS_PER_BUCKET = 50_000
#: Slots (patterns times their lengths) up to which they are sent to every task.
SMALL_SLOTS = 200_000


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, item: str, text: str, vocabulary: str = TOKENIZER) -> DataFrame:
    """(item, tokens) of every row; a null text has 0 tokens. Only the two columns are read."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({item: batch[item], "tokens": [len(encode(t)) if t else 0 for t in batch[text]]})

    rows = df.select(F.col(item).cast("long").alias(item), F.col(text).alias(text))
    return rows.mapInPandas(count, f"{item} long, tokens long")


Pattern = tuple[tuple[int, int], ...]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns ((length, times), ...) of one container each, and how often each is used.

    Lengths (1..capacity) are placed longest first, always into the shortest packs, those with the most
    room. All packs of a pattern are filled at once and until they are no longer the shortest; what finds
    no room opens new packs. The work follows the number of distinct lengths and patterns, not of texts.
    """
    by_room: dict[int, dict[Pattern, int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not by_room[room]:
            insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                put(capacity, (), -(-left // (capacity // length)))
            room = rooms[-1]
            pattern, n = by_room[room].popitem()
            if not by_room[room]:
                rooms.pop()
            below = rooms[-1] if rooms else 0
            times = min(max(1, -(-(room - below) // length)), room // length, left)
            used = min(n, left // times)
            put(room - times * length, (*pattern, (length, times)), used)
            if n > used:
                put(room, pattern, n - used)
            left -= times * used
    return sorted((p, n) for same in by_room.values() for p, n in same.items() if p)


def _slots(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each pattern and length in it: (length, first rank, last rank, times, first container, first slot).

    Texts of a length are handed out in rank order, so the containers of a pattern take consecutive ranks.
    """
    taken: dict[int, int] = defaultdict(int)
    out, container = [], 0
    for pattern, n in patterns:
        slot = 0
        for length, times in pattern:
            out.append((length, taken[length] + 1, taken[length] + times * n, times, container, slot))
            taken[length] += times * n
            slot += times
        container += n
    return out


def pack(df: DataFrame, item: str, text: str, capacity: int = CAPACITY, vocabulary: str = TOKENIZER, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(item, piece, tokens, item_tokens, container, slot): where each piece of each text goes.

    A text within the capacity is one piece, 0. A text that alone exceeds it is cut after every ``capacity``
    tokens; its full pieces fill a container each, the rest is packed like any other text. Null and empty
    texts hold no tokens and need no container, so they are left out. Repeated texts under other ids are
    texts of their own.
    """
    spark = df.sparkSession
    sizes = cut(token_counts(df, item, text, vocabulary).where("tokens > 0"))
    whole = F.floor((F.col("tokens") - 1) / capacity).cast("long")
    pieces = sizes.select(item, F.col("tokens").alias("item_tokens"), F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("piece"))
    pieces = pieces.withColumn("tokens", F.least(F.lit(capacity).cast("long"), F.col("item_tokens") - F.col("piece") * capacity))
    histogram = {r["tokens"]: r["n"] for r in pieces.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(pack_histogram(histogram, capacity))
    # Bounded by the patterns over at most `capacity` lengths.
    slots_df = spark.createDataFrame(slots or [(0, 0, -1, 1, 0, 0)], "tokens long, first long, last long, each long, base long, slot0 long")

    # A length may hold most texts: it is spread over buckets by a hash, and the buckets' counts give offsets.
    buckets = max(1, -(-max(histogram.values(), default=1) // rows_per_bucket))
    spread = pieces.withColumn("_b", F.pmod(F.xxhash64(item, "piece"), F.lit(buckets)))
    counts = spread.groupBy("tokens", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tokens", "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # A length's bucket takes one run of ranks: it gets the slots that overlap it, so a row looks through few of them
    # however many patterns its length is part of, and no range join is needed.
    runs = slots_df.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("first", "last", "each", "base", "slot0"))).alias("_runs"))
    few = len(slots) <= SMALL_SLOTS
    within = F.filter("_runs", lambda r: (r["last"] > F.col("_off")) & (r["first"] <= F.col("_off") + F.col("_n")))
    slices = offsets.join(F.broadcast(runs) if few else runs, "tokens").select("tokens", "_b", "_off", within.alias("_runs"))
    numbered = spread.withColumn("_rn", F.row_number().over(Window.partitionBy("tokens", "_b").orderBy(item, "piece")))
    ranked = numbered.join(F.broadcast(slices) if few and buckets == 1 else slices, ["tokens", "_b"]).withColumn("_rank", F.col("_off") + F.col("_rn"))
    placed = ranked.withColumn("_run", F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") <= r["last"]))[0])
    nth = F.col("_rank") - F.col("_run.first")
    return placed.select(
        item,
        "piece",
        "tokens",
        "item_tokens",
        (F.col("_run.base") + F.floor(nth / F.col("_run.each"))).cast("long").alias("container"),
        (F.col("_run.slot0") + nth % F.col("_run.each")).cast("long").alias("slot"),
    )
