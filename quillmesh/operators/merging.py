"""Ledger union: replicas of an event log merged by identity, late rows included."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_identified(events: DataFrame, identity: str, order: list[Column], line: Column, refuse: bool = False) -> DataFrame:
    """(identity, line, copies, conflict, position): each identified event once, ordered by clock and identity.

    Of textual variants the least line stays; variants that differ in content are a conflict, which is an error if the
    merge is to ``refuse`` it. Nothing is ever dropped as late: a replay follows a merge.
    """
    rows = events.select(identity, line.alias("_line"), *(o.alias(f"_o{i}") for i, o in enumerate(order)))
    once = rows.groupBy(identity).agg(F.min("_line").alias("line"), F.count(F.lit(1)).alias("copies"), (F.countDistinct("_line") > 1).alias("conflict"), *(F.min(f"_o{i}").alias(f"_o{i}") for i in range(len(order))))
    merged = once.select(identity, "line", "copies", "conflict", *(f"_o{i}" for i in range(len(order))))
    if refuse:
        wrong = merged.where("conflict").select(identity).limit(1).collect()
        if wrong:
            raise ValueError(f"two events of one identity: {wrong[0][0]!r}")
    return merged


def union_legacy(replicas: DataFrame, replica: str, line: str) -> DataFrame:
    """(line, occurrence): unidentified lines at their greatest multiplicity in any replica."""
    counted = replicas.groupBy(replica, line).agg(F.count(F.lit(1)).alias("n")).groupBy(line).agg(F.max("n").alias("n"))
    return counted.select(line, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("occurrence"))


def legacy_order(replicas: DataFrame, replica: str, ordinal: str, line: str, most: int = 1_000_000) -> list[tuple[str, int]]:
    """(line, occurrence) of unidentified lines in an order that every replica agrees with, the least of those that may
    come next first.

    An order of all lines is one sequence, so it is made on the driver, of at most ``most`` lines; more, and replicas
    that contradict each other, are an error.
    """
    nth = F.row_number().over(Window.partitionBy(replica, line).orderBy(ordinal)).alias("n")
    rows = replicas.select(replica, ordinal, line, nth).orderBy(replica, ordinal).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lines to put in order")
    waits: dict[tuple[str, int], set[tuple[str, int]]] = {}
    last: dict[object, tuple[str, int]] = {}
    for r in rows:
        node = (r[line], r["n"])
        waits.setdefault(node, set())
        if r[replica] in last:
            waits[node].add(last[r[replica]])
        last[r[replica]] = node
    after: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for node, before in waits.items():
        for b in before:
            after.setdefault(b, []).append(node)
    left = {node: len(before) for node, before in waits.items()}
    ready = [node for node, n in left.items() if not n]
    heapify(ready)
    out = []
    while ready:
        out.append(heappop(ready))
        for node in after.get(out[-1], ()):
            left[node] -= 1
            if not left[node]:
                heappush(ready, node)
    if len(out) < len(waits):
        raise ValueError("replicas contradict each other in the order of their lines")
    return out


def transcript_turns(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn, role, text) of chat transcripts written as ``role: ...`` paragraphs."""
    pattern = r"(?s)(?:^|(?<=\n\n))(user|assistant|system): (.*?)(?=\n\n(?:user|assistant|system): |\z)"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    rows = texts.select(key, F.posexplode(found).alias("turn", "_m"))
    return rows.select(key, F.col("turn").cast("long").alias("turn"), F.regexp_extract("_m", r"^(\w+): ", 1).alias("role"), F.regexp_replace("_m", r"^\w+: ", "").alias("text"))


def episodes(turns: DataFrame, key: str, per_session: int = 30, clip: int = 240) -> DataFrame:
    """(key, messages, body): a session's first user messages on one line each, clipped, secrets scrubbed; messages
    that are markup or interruptions are passed over."""
    from quillmesh.functions import text as T

    said = turns.where("role = 'user'").withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " "))).where("t <> '' AND NOT startswith(t, '<') AND NOT startswith(t, '[Request')")
    said = said.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("turn"))).where(F.col("n") <= per_session)
    short = F.when(F.length("t") <= clip, F.col("t")).otherwise(F.concat(F.regexp_replace(F.left("t", F.lit(clip)), " [^ ]*$", ""), F.lit(" …")))
    lines = said.select(key, "n", T.scrub(short).alias("line"))
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
