"""Writers: postings tables, note indexes, node-link graphs, Mermaid text, idempotent ledger appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.positions import number_rows
from quillmesh.session import cut


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``; an unreachable store is an error and not an empty table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and len(files.listStatus(where)) > 0


def index_lines(notes: DataFrame) -> DataFrame:
    """(folder, line) of an index: one line a note, in order of path within its top folder."""
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    line = F.concat(F.lit("* ["), F.coalesce("title", F.lit("")), F.lit("](/"), "path", F.lit(")"), F.when(F.length("description") > 0, F.concat(F.lit(" - "), "description")).otherwise(F.lit("")))
    return notes.select(top.alias("folder"), "path", line.alias("line"))


def node_link(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(part, json) rows of a fused graph, to be written as text; both ends of a link must be nodes."""
    ids = nodes.select("id")
    kept = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(*nodes.columns)).alias("json")).unionByName(kept.select(F.lit("link").alias("part"), F.to_json(F.struct("source", "target", *(c for c in kept.columns if c not in ("source", "target")))).alias("json")))


def mermaid(nodes: DataFrame, links: DataFrame, top: int = 40) -> str:
    """A diagram of the ``top`` nodes (id, label, strength) by strength, degree and id, and the links among them."""
    ends = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    best = nodes.join(ends, "id", "left").orderBy(F.col("strength").desc(), F.coalesce("degree", F.lit(0)).desc(), "id").limit(top).collect()
    number = {r["id"]: i for i, r in enumerate(best)}
    inside = links.where(F.col("source").isin(list(number)) & F.col("target").isin(list(number))).select("source", "target", "relation").distinct().orderBy("source", "target", "relation").collect() if number else []
    out = ["graph LR", *(f'  n{i}["{str(r["label"]).replace(chr(34), chr(39))}"]' for i, r in enumerate(best))]
    return "\n".join([*out, *(f"  n{number[l['source']]} -->|{l['relation']}| n{number[l['target']]}" for l in inside)])


def append_events(events: DataFrame, path: str, now_ms: int) -> DataFrame:
    """Appends events that the ledger does not hold yet, by ``sync_id``, each with the next clock.

    The clock is above all that was seen and at least ``now_ms``; run again with the same events it adds none.
    """
    spark = events.sparkSession
    old = spark.read.parquet(path) if has_files(spark, path) else None
    new = events if old is None else events.join(old.select("sync_id"), "sync_id", "left_anti")
    seen = 0 if old is None else (old.agg(F.max("sync_clock")).first()[0] or 0)
    # Numbered over range partitions, so no task sees the whole batch.
    numbered = number_rows(new.withColumn("_all", F.lit(0)), "_all", [F.col("ts"), F.col("sync_id")], "_n", hot_rows=0).drop("_all")
    stamped = cut(numbered.withColumn("sync_clock", F.lit(max(seen + 1, now_ms) - 1) + F.col("_n")).drop("_n"))
    stamped.write.mode("append").parquet(path)
    return stamped
