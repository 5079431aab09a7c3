import json

import pytest
from pyspark.sql import functions as F

from quillmesh.sources import bundle, sinks
from quillmesh.streaming import processors


def test_frontmatter():
    meta, body = bundle.frontmatter('---\ntitle: "A: b"\ntags: [x, "y, z"]\npinned: true\nn: 3\nr: 1.5\nm: {a: 1}\nlist:\n  - one\n  - 2\n---\nBody\n')
    assert meta == {"title": "A: b", "tags": ["x", "y, z"], "pinned": True, "n": 3, "r": 1.5, "m": {"a": 1}, "list": ["one", 2]} and body == "Body\n"
    assert bundle.frontmatter("---\nno header\n---\nx")[0] == {}
    assert bundle.frontmatter("plain") == ({}, "plain")


def test_reads_a_bundle(spark, tmp_path):
    (tmp_path / "people").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "people" / "ada.md").write_text("---\ntitle: Ada\nsupersedes: [people/old.md]\n---\nHello")
    (tmp_path / "plain.md").write_text("No header")
    (tmp_path / "index.md").write_text("reserved")
    (tmp_path / ".hidden" / "x.md").write_text("x")
    got = {r["path"]: r for r in bundle.read_notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"people/ada.md", "plain.md"} and got["people/ada.md"]["type"] == "people" and got["people/ada.md"]["supersedes"] == ["people/old.md"]
    assert {r["path"] for r in bundle.read_notes(spark, str(tmp_path), ["people/"]).collect()} == {"plain.md"}
    with pytest.raises(ValueError):
        bundle.read_notes(spark, str(tmp_path), ["../x"])


def test_reads_a_ledger(spark, tmp_path):
    lines = ['{"kind":"touch","note":"a","ts":1.5,"extra":1}', "", "not json", '["list"]', '{"kind":"goal"}']
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    got = bundle.read_ledger(spark, str(tmp_path / "l.jsonl")).orderBy("ordinal").collect()
    assert [r["kind"] for r in got] == ["touch", "goal"] and json.loads(got[0]["payload"])["extra"] == 1


def test_reads_a_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}, {"id": "a", "label": "A"}, {"id": "b"}], "edges": [{"source": "a", "target": "b", "_src": "b", "_tgt": "a", "relation": "uses"}]}))
    nodes, links = bundle.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and [(r["source"], r["target"]) for r in links.collect()] == [("b", "a")]


def test_reads_transcripts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"role":"user","content":"hi"}\n{"type":"user","message":{"role":"user","content":[{"type":"text","text":"there"}]}}\n{}')
    assert sorted(r["text"] for r in bundle.read_transcripts(spark, str(tmp_path / "t.jsonl")).collect()) == ["hi", "there"]


def test_fingerprint_changes_with_content(spark):
    a = spark.createDataFrame([("p", "x"), ("q", None)], "p string, t string")
    b = spark.createDataFrame([("q", None), ("p", "x")], "p string, t string")
    c = spark.createDataFrame([("p", "y"), ("q", None)], "p string, t string")
    d = [bundle.fingerprint(x, "p", "t").first()["digest"] for x in (a, b, c)]
    assert d[0] == d[1] != d[2]


def test_append_is_idempotent(spark, tmp_path):
    e = spark.createDataFrame([("i1", "touch", 1.0), ("i2", "touch", 2.0)], "sync_id string, kind string, ts double")
    path = str(tmp_path / "ledger")
    sinks.append_events(e, path, 1000)
    sinks.append_events(e, path, 1000)
    rows = spark.read.parquet(path).orderBy("sync_clock").collect()
    assert [r["sync_id"] for r in rows] == ["i1", "i2"] and rows[0]["sync_clock"] >= 1000


def test_mermaid_and_node_link(spark):
    nodes = spark.createDataFrame([("a", "A", 1.0), ("b", "B", 0.5)], "id string, label string, strength double")
    links = spark.createDataFrame([("a", "b", "uses"), ("a", "zz", "uses")], "source string, target string, relation string")
    assert sinks.mermaid(nodes, links, 2).count("-->") == 1
    assert sinks.node_link(nodes, links).where("part = 'link'").count() == 1


def _stream(spark, tmp_path, batches, schema):
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("*.parquet"):
            f.rename(src / f"{i:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def _run(df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


def test_streams_agree_with_batch(spark, tmp_path):
    schema = "user long, ordinal long, seconds double"
    batches = [[(1, 0, 0.0), (1, 1, 30.0), (2, 2, 5.0)], [(1, 3, 61.0), (1, 4, 2000.0)], [(1, 5, 3800.0), (2, 6, 1805.0)]]
    stream = _stream(spark, tmp_path, batches, schema)
    _run(processors.infer_sessions(stream, "user"), "sessions_out", tmp_path)
    got = {r["ordinal"]: r["session"] for r in spark.sql("select * from sessions_out").collect()}
    assert got == {0: 1, 1: 1, 3: 1, 4: 2, 5: 2, 2: 1, 6: 1}
    _run(processors.debounce(stream, "user"), "debounce_out", tmp_path)
    assert sorted(r["ordinal"] for r in spark.sql("select * from debounce_out").collect()) == [0, 2, 3, 4, 5, 6]


def test_idempotent_stream(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[("a", 1.0)], [("a", 1.0), ("b", 2.0)]], "sync_id string, ts double")
    out = str(tmp_path / "out")
    q = processors.idempotent_append(stream, out, str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["sync_id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    assert spark.read.parquet(out).select(F.count(F.lit(1))).first()[0] == 2
