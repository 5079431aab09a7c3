"""Readers: Markdown bundles with frontmatter, JSON-lines ledgers, node-link graphs, chat transcripts, source trees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds that fail a bundle rather than truncate it.
NOTE_BYTES, BUNDLE_BYTES, BUNDLE_NOTES = 8 * 2**20, 64 * 2**20, 20_000
#: The name of a bundle's own list of files to pass over.
EXCLUSION_FILE = ".bundleignore"
RESERVED = ("index.md", "log.md")
_NUMBER = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?$|[+-]?\d+[eE][+-]?\d+$")


def scalar(value: str) -> object:
    """A header value: true/false, integer, float, list, one-level map, else text."""
    v = value.strip()
    if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
        return v[1:-1]
    if v[:1] == "[" and v[-1:] == "]":
        return [scalar(p) for p in _split(v[1:-1])]
    if v[:1] == "{" and v[-1:] == "}":
        return {k.strip(): scalar(x) for k, _, x in (p.partition(":") for p in _split(v[1:-1]))}
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    if re.fullmatch(r"[+-]?\d+", v):
        return int(v)
    return float(v) if _NUMBER.match(v) else v


def _split(inner: str) -> list[str]:
    """Parts at commas outside quotes and brackets."""
    out, depth, quote, part = [], 0, "", ""
    for c in inner:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(part.strip())
            part = ""
            continue
        part += c
    return [*out, part.strip()] if part.strip() else out


def frontmatter(text: str) -> tuple[dict, str]:
    """(header, body). A header without one key is none: the whole text is then the body."""
    m = re.match(r"---[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\Z)", text, re.S | re.M)
    if not m:
        return {}, text
    header: dict = {}
    last = None
    for line in m[1].splitlines():
        item = re.match(r"\s*-\s+(.*)$", line)
        pair = re.match(r"([\w.-]+)\s*:\s*(.*)$", line)
        if item and last is not None and isinstance(header.get(last), list):
            header[last].append(scalar(item[1]))
        elif pair:
            last = pair[1]
            header[last] = scalar(pair[2]) if pair[2].strip() else []
    return (header, text[m.end() :]) if header else ({}, text)


def read_notes(spark: SparkSession, root: str, exclude: list[str] | None = None, bounded: bool = True) -> DataFrame:
    """(path, type, title, description, tags, status, pinned, supersedes, stale_after, meta, body) of a folder's notes.

    Hidden folders and reserved files are passed over; ``exclude`` names files and, with a slash at the end,
    trees; the folder's own exclusion file, one such name a line, counts as well. Texts that are no UTF-8 are read with
    replacements. Past a bound the read fails; ``bounded=False`` lifts the bounds on a bundle's notes and bytes,
    which protect a single machine and not a cluster.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
    files = files.select(rel.alias("path"), "length", "content").where(~F.col("path").rlike(r"(?:^|/)\.") & ~F.element_at(F.split("path", "/"), -1).isin(*RESERVED))
    for e in [*(exclude or []), *_exclusion_file(spark, base)]:
        if e.startswith("/") or ".." in e.split("/") or "*" in e:
            raise ValueError(f"not an exclusion: {e}")
        files = files.where(~F.col("path").startswith(e) if e.endswith("/") else F.col("path") != e)
    size = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.max("length").alias("most")).first()
    if bounded and (size["n"] > BUNDLE_NOTES or (size["bytes"] or 0) > BUNDLE_BYTES) or (size["most"] or 0) > NOTE_BYTES:
        raise ValueError(f"bundle beyond its bounds: {size['n']} notes, {size['bytes']} bytes")

    def listed(value: object) -> list[str]:
        return [str(v) for v in value] if isinstance(value, list) else [v for v in re.split(r",\s*", str(value)) if v] if value not in (None, "") else []

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                meta, body = frontmatter(bytes(content).decode("utf-8", "replace"))
                stem = path.rsplit("/", 1)[-1][:-3]
                rows.append((path, str(meta.get("type") or path.split("/")[0]), str(meta.get("title") or stem), str(meta.get("description", "")), listed(meta.get("tags")), str(meta.get("status") or "stable"),
                             bool(meta.get("pinned", False)), listed(meta.get("supersedes")), str(meta.get("stale_after", "")), json.dumps(meta, default=str, sort_keys=True), body))
            yield pd.DataFrame(rows, columns=["path", "type", "title", "description", "tags", "status", "pinned", "supersedes", "stale_after", "meta", "body"])

    schema = "path string, type string, title string, description string, tags array<string>, status string, pinned boolean, supersedes array<string>, stale_after string, meta string, body string"
    return files.select("path", "content").mapInPandas(work, schema)


def _exclusion_file(spark: SparkSession, base: str) -> list[str]:
    """Names in the folder's exclusion file, without blank lines and comments; none where there is no such file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{EXCLUSION_FILE}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return []
    lines = (r["value"].strip() for r in spark.read.text(f"{base}/{EXCLUSION_FILE}").limit(10_000).collect())
    return [line for line in lines if line and not line.startswith("#")]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, kind, note, session, ts, valence, sync_clock, sync_id, payload) of a JSON-lines ledger in file order.

    Blank lines, lines that are no JSON and values that are no object are passed over; unknown fields stay in
    ``payload``.
    """
    lines = spark.read.text(path, wholetext=False).withColumn("ordinal", F.monotonically_increasing_id()).where("ltrim(value) LIKE '{%'")
    schema = "kind string, note string, session string, ts double, valence double, sync_clock long, sync_id string"
    parsed = lines.select("ordinal", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), F.col("value").alias("payload"), F.try_parse_json("value").alias("v"))
    return parsed.where("v IS NOT NULL").select("ordinal", "e.*", "payload")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a node-link JSON file; ``edges`` stands for ``links``, ``_src`` and ``_tgt`` for flipped ends."""
    node = "id string, label string, kind string, file_type string, body string, source_file string"
    link = "source string, target string, _src string, _tgt string, relation string, confidence string"
    raw = spark.read.schema(f"nodes array<struct<{_fields(node)}>>, links array<struct<{_fields(link)}>>, edges array<struct<{_fields(link)}>>").option("multiLine", "true").json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*").dropDuplicates(["id"])
    links = raw.select(F.explode(F.coalesce("links", "edges")).alias("l"))
    return nodes, links.select(F.coalesce("l._src", "l.source").alias("source"), F.coalesce("l._tgt", "l.target").alias("target"), "l.relation", "l.confidence")


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (p.split(" ") for p in ddl.split(", ")))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, turn, role, text) of JSON-lines chat transcripts, one session a file; list contents are joined."""
    lines = spark.read.text(path).select(F.input_file_name().alias("doc_id"), F.monotonically_increasing_id().alias("turn"), "value")
    role = F.coalesce(F.get_json_object("value", "$.role"), F.get_json_object("value", "$.message.role"), F.get_json_object("value", "$.type"))
    text = F.coalesce(F.get_json_object("value", "$.content"), F.get_json_object("value", "$.message.content"), F.get_json_object("value", "$.text"))
    parts = F.array_join(F.transform(F.from_json(text, "array<struct<type: string, text: string>>"), lambda p: F.coalesce(p["text"], F.lit(""))), " ")
    return lines.select("doc_id", "turn", role.alias("role"), F.when(text.startswith("["), parts).otherwise(text).alias("text")).where("role IS NOT NULL AND text IS NOT NULL")


def fingerprint(files: DataFrame, path: str, text: str) -> DataFrame:
    """One row (files, digest) that changes with any path or text: per-file hashes are folded by a sum that combines
    in any order, so no task sees all of them."""
    h = F.xxhash64(F.coalesce(path, F.lit("")), F.coalesce(text, F.lit("")))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(h.cast("decimal(38,0)")).alias("s")).select("files", F.sha2(F.concat_ws(":", "files", "s"), 256).alias("digest"))
