"""Writing notes, notes from graphs, registers, rules and reviews."""

import os

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import learning, ledger, notebook
from quillmesh.sources import bundle


def _col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_paths_that_may_be_written(spark):
    good, bad = ["a/b.md", " x.md ", "a\\b.md"], ["/a.md", "../a.md", "a/../b.md", ".h/a.md", "a.txt", "index.md", "x/LOG.md", "C:/a.md", "a//b.md", "", None, "a\x00.md"]
    assert _col(spark, good, notebook.canonical_path) == ["a/b.md", "x.md", "a/b.md"] and _col(spark, bad, notebook.canonical_path) == [None] * len(bad)


def test_written_notes_are_read_again(spark, tmp_path):
    rows = [("p/a.md", 'A: "b"', ["x", "y, z"], True, "Body\n\nmore"), ("c.md", "[odd]", [], False, None), ("d.md", "12", None, None, "x")]
    df = spark.createDataFrame(rows, "path string, title string, tags array<string>, pinned boolean, body string")
    text = notebook.rendered({"title": notebook.header_value(F.col("title")), "tags": notebook.header_list(F.col("tags")), "pinned": F.col("pinned").cast("string")}, F.col("body"))
    assert notebook.write_notes(df.withColumn("t", text), "path", "t", str(tmp_path)) == 3
    got = {r["path"]: r for r in bundle.read_notes(spark, str(tmp_path)).collect()}
    assert got["p/a.md"]["title"] == "A: 'b'" and got["p/a.md"]["tags"] == ["x", "y, z"] and got["p/a.md"]["pinned"] and got["p/a.md"]["body"].strip() == "Body\n\nmore"
    assert got["c.md"]["title"] == "[odd]" and got["d.md"]["title"] == "12"
    with pytest.raises(ValueError):
        notebook.write_notes(spark.createDataFrame([("../x.md", "t")], "path string, t string"), "path", "t", str(tmp_path))
    assert not os.path.exists(tmp_path.parent / "x.md") and not [f for f in os.listdir(tmp_path) if f.startswith(".") and f.endswith("tmp")]


def test_only_moved_names_are_led_anew(spark):
    links = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, name string")
    ids = lambda rows: spark.createDataFrame(rows, "name string, target string")
    got = notebook.stale_links(links, ids([("x", "1"), ("y", "2")]), ids([("x", "1"), ("y", "3"), ("z", "4")]), "path")
    assert sorted(r["path"] for r in got.collect()) == ["b", "c"]


def test_notes_from_a_graph(spark):
    nodes = spark.createDataFrame([("1", "Load Ledger", "code", "Doc.", 1), ("2", "load-ledger", "code", "", 2), ("3", "index", "code", None, 3), ("4", "Kept", "code", "new", 4), ("5", None, "", None, 5), ("6", "Old", "code", "", 6)], "id string, label string, folder string, body string, ordinal int")
    links = spark.createDataFrame([("1", "2", "calls", None, 0), ("1", "3", None, "Very Sure", 1), ("1", "4", "calls", "extracted", 2), ("4", "1", "calls", "extracted", 0), ("1", "99", "calls", "x", 3), ("6", "1", "calls", "extracted", 0)], "source string, target string, relation string, confidence string, n int")
    old = spark.createDataFrame([("code/kept.md", "Kept", "curated", "mine"), ("code/old.md", "Old", "extracted", "x\n- likes [[Load Ledger]] (inferred)\n- gone [[Y]] (extracted)"), ("code/index-node.md", "index", "inferred", "index"), ("z.md", "load ledger", None, "")], "path string, title string, provenance string, body string")
    got = {r["id"]: r for r in notebook.notes_from_graph(nodes, links, old).collect()}
    assert {k: r["path"] for k, r in got.items()} == {"1": "code/load-ledger.md", "2": "code/load-ledger-2.md", "3": "code/index-node.md", "4": "code/kept.md", "5": "5.md", "6": "code/old.md"}
    assert {k: r["state"] for k, r in got.items()} == {"1": "new", "2": "new", "3": "same", "4": "protected", "5": "new", "6": "changed"}
    assert got["1"]["body"] == "Doc.\n\n## Connections\n\n- calls [[load-ledger]] (inferred)\n- related_to [[index]] (very-sure)"
    assert got["6"]["body"] == "## Connections\n\n- calls [[code/load-ledger.md|Load Ledger]] (extracted)\n- likes [[Load Ledger]] (inferred)" and got["4"]["body"] == "mine" and got["5"]["body"] == "5"
    few = {r["id"]: r["body"] for r in notebook.notes_from_graph(nodes, links, old, connections=1).collect()}
    assert few["1"].count("\n- ") == 1
    assert notebook.notes_from_graph(nodes, links, old, plan=lambda n: n.where("id = '1'")).count() == 1 and notebook.notes_from_graph(nodes.limit(0), links, old).count() == 0


def test_observed_files(spark):
    notes = spark.createDataFrame([("n1.md", "src/a.py"), ("n2.md", "app/src/a.py"), ("n3.md", "README.md"), ("n4.md", "/abs/b.py"), ("n5.md", "src/a.py"), ("n6.md", None)], "path string, resource string")
    seen = [(1, "/home/me/app/src/a.py"), (2, "./src/a.py"), (3, "/x/README.md"), (4, "/abs/b.py"), (5, "n6.md"), (6, ""), (7, None), (8, "README.md"), (9, "/q/zsrc/a.py")]
    got = {r["k"]: r["path"] for r in notebook.observed_notes(spark.createDataFrame(seen, "k int, v string"), "k", "v", notes).collect()}
    assert got == {1: "n2.md", 2: "n1.md", 4: "n4.md", 5: "n6.md", 8: "n3.md"}


def test_small_texts(spark):
    assert _col(spark, ["90m", " 4H", "2d", "15", "1.5h", "x", "", None, "3w"], T.duration) == [5400.0, 14400.0, 172800.0, 15.0, 5400.0, None, None, None, None]
    assert _col(spark, [0.0, 59.0, 3599.0, 3600.0, 86399.0, 200000.0, -5.0], T.age, "double") == ["1m", "1m", "59m", "1h", "23h", "2d", "1m"]
    assert _col(spark, ["Chief  Executive Officer", "Head of Data"], T.role) == ["ceo", "head_of_data"]
    assert _col(spark, ["/a/b", "a\\b.md", "", "../x", "a//./b"], T.ledger_path) == ["a/b.md", "a/b.md", "", "../x.md", "a/b.md"]
    df = spark.createDataFrame([(1, "0" * 32, True), (0, "0" * 32, False), (1, "0" * 31, False), (None, None, False), (5, "A" * 32, False)], "c long, i string, want boolean")
    assert all(r["g"] == r["want"] for r in df.withColumn("g", T.ledger_stamp(F.col("c"), F.col("i"))).collect())
    types = spark.createDataFrame([(" Person ", "x/a.md", "person"), (None, "People/a.md", "person"), ("", "misc/a.md", "")], "d string, p string, want string")
    assert all(r["g"] == r["want"] for r in types.withColumn("g", T.note_type(F.col("d"), F.col("p"))).collect())
    assert notebook.situation_cues("/home/me/app/", "main", [f"src/f{i}.py" for i in range(20)], "Fix it", ["t"] * 9)[0] == ("app", 0.8, "folder") and len(notebook.situation_cues("/a", "b", ["c"] * 20, "d", ["t"] * 9)) == 18


def test_registers(spark):
    rows = [("a", "pin", 1.0, 1), ("a", "pin", 0.0, 2), ("b", "pin", 1.0, 3), ("b", "supersede", None, 4), ("b", "goal", 3.0, 5), ("c", "goal", 0.5, 6), ("c", "goal", 0.0, 7), ("a", "touch", 1.0, 8)]
    e = spark.createDataFrame(rows, "note string, kind string, valence double, ordinal long")
    assert {r["note"]: (r["pinned"], r["superseded"]) for r in ledger.pins(e).collect()} == {"a": (False, False), "b": (True, True)}
    assert {r["note"]: r["weight"] for r in ledger.goals(e).collect()} == {"b": 1.0}
    i = spark.createDataFrame([("m", "intent", 100.0, 1.0, 1), ("n", "intent", 100.0, 500.0, 2), ("n", "intent-done", 120.0, None, 3), ("o", "intent", 10.0, 20.0, 4), ("p", "intent", 0.0, None, 5)], "branch string, kind string, ts double, ttl double, ordinal long")
    assert {r["branch"]: r["expires"] for r in ledger.intents(i, 130.0).collect()} == {"m": 160.0, "p": 86400.0} and ledger.intents(i, 130.0, keep=1).count() == 1 and ledger.intents(i, 130.0, keep=None).count() == 2
    g = spark.createDataFrame([("x", "s1", 1.0), ("x", "s2", 2.0), ("y", "s1", 3.0)], "path string, session string, ts double")
    assert [(r["path"], r["n"], r["sessions"]) for r in ledger.gaps(g, "path", "session").collect()] == [("x", 2, 2), ("y", 1, 1)] and ledger.gaps(g, "path", "session", 1).count() == 1


def test_rules_evolve(spark):
    cluster = lambda d, p, n, count, sessions, words, ts: (d, p, n, f"r{n}", count, sessions, f"text {n}", ts, words)
    rows = [cluster("code", 1, 0, 4, 2, ["alpha", "bravo"], 50.0), cluster("code", -1, 1, 3, 2, ["alpha", "bravo", "x"], 60.0), cluster("code", 1, 2, 2, 1, ["lone", "pair"], 70.0), cluster("code", 1, 3, 1, 1, ["once", "only"], 70.0), cluster("docs", 1, 4, 5, 3, ["old", "law"], 5.0), cluster("docs", -1, 5, 5, 3, ["law", "old"], 99.0)]
    c = spark.createDataFrame(rows, "domain string, polarity int, cluster int, rule_id string, count long, sessions long, text string, ts double, words array<string>")
    reg = spark.createDataFrame([("docs", "r4", 1, "text 4", ["old", "law"], "active", 10.0)], "domain string, rule_id string, polarity int, text string, words array<string>, status string, ts double")
    got = learning.evolved(c, reg)
    assert {(r["domain"], r["action"], r["rule_id"]) for r in got.collect()} == {("code", "promoted", "r1"), ("code", "candidate", "r2"), ("docs", "demoted", "r4"), ("docs", "promoted", "r5")}
    assert [r["rule_id"] for r in learning.whispers(got).collect()] == ["r2"]
    again = spark.createDataFrame([("docs", "r5", -1, "t", ["law", "old"], "active", 99.0), ("code", "r1", -1, "t", ["alpha", "bravo", "x"], "active", 60.0)], reg.schema)
    assert {r["action"] for r in learning.evolved(c, again).collect()} == {"candidate"}
    pages = {r["domain"]: r["body"] for r in notebook.rule_pages(spark.createDataFrame([("d", "r2", "gone", 3, 2, "superseded", "2026-01-01"), ("d", "r1", "kept", 4, 2, None, "2026-02-02")], "domain string, rule_id string, text string, count long, sessions long, status string, since string")).collect()}
    assert pages["d"] == "- kept  *(evidence: 4 event(s), 2 session(s), promoted 2026-02-02)*\n\n- ~~gone~~  *(superseded 2026-01-01)*"


def test_reviews(spark):
    rows = [("s", "recall", "a"), ("s", "touch", "a"), ("s", "touch", "m"), ("s", "recall", "w"), ("done", "touch", "z"), ("short", "touch", "q")]
    e = spark.createDataFrame(rows, "session string, kind string, note string")
    cues = spark.createDataFrame([("s", "ledger replay clock"), ("short", "one")], "session string, text string")
    known = spark.createDataFrame([("a", t) for t in T.term_list("ledger replay")], "note string, term string")
    got = learning.reviews(e, "session", cues, known, spark.createDataFrame([("done",)], "session string")).collect()
    assert {(r["note"], r["outcome"]) for r in got if r["term"] is None} == {("a", "hit"), ("m", "miss"), ("w", "waste"), ("q", "miss")}
    assert {(r["note"], r["w"]) for r in got if r["term"]} == {("m", 0.5), ("a", 0.2)} and sum(bool(r["term"]) for r in got) == 6


def test_code_sessions_and_folders(spark):
    n = lambda *xs: spark.createDataFrame([(x,) for x in xs], "note string")
    assert {(r["kind"], r["note"]) for r in learning.code_session("s", "q", n("a", "b", "a"), n("b"), 1.0).collect()} == {("recall", "a"), ("recall", "b"), ("touch", "b")}
    hits = spark.createDataFrame([(1, f"f{i}", f"d{i % 3}", i + 1) for i in range(12)], "q long, file string, folder string, rank int")
    use = spark.createDataFrame([(1, "d2", 0.9), (1, "d1", 0.1)], "q long, folder string, strength double")
    out = [r["file"] for r in learning.directory_personalized(hits, use, "q", "file").orderBy("rank").collect()]
    assert out[0] == "f0" and sorted(out) == sorted(f"f{i}" for i in range(12)) and out.index("f11") < out.index("f10")
