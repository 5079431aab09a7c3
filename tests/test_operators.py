"""Operators against small independent models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import extract, fusion, graph, learning, ledger, lexical, merging, positions, recall, relations


def test_bm25f_against_a_model(spark, monkeypatch, tmp_path):
    docs = {"a": ("ledger replay", "ledger ledger note"), "b": ("session", "note " * 50), "c": ("", None)}
    df = spark.createDataFrame([(k, t, b) for k, (t, b) in docs.items()], "key string, title string, body string")
    cues = lexical.cue_terms(spark.createDataFrame([(1, "ledger notes"), (2, "")], "q long, text string"), "q", "text")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    hits = lexical.lookup(df, "key", {"title": F.col("title"), "body": F.col("body")}, cues)
    got = {(r["q"], r["key"]): r["score"] for r in lexical.bm25f(hits, "key", n, cues, "q").collect()}
    nothing = lexical.lookup(df.limit(0), "key", {"title": F.col("title"), "body": F.col("body")}, cues)
    assert lexical.bm25f(nothing, "key", df.limit(0).agg(F.count(F.lit(1)).alias("n")), cues, "q").count() == 0 == lexical.overlap_hits(nothing, "key", cues, "q", lexical.OVERLAP_WEIGHTS).count()
    assert lexical.lookup(df, "key", {"title": F.col("title")}, cues.limit(0)).where("term IS NOT NULL").count() == 0
    # The same from a written index, by literal terms and by a join, and past the size of a broadcast.
    lexical.write_index(df, "key", {"title": F.col("title"), "body": F.col("body")}, "hits_of_docs", str(tmp_path), 4)
    for literal in (400, 0):
        again = lexical.bm25f(lexical.read_index(spark, "hits_of_docs", cues, literal), "key", n, cues, "q").collect()
        assert {(r["q"], r["key"]): r["score"] for r in again} == got
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert {(r["q"], r["key"]): r["score"] for r in lexical.bm25f(lexical.lookup(df, "key", {"title": F.col("title"), "body": F.col("body")}, cues), "key", n, cues, "q").collect()} == got
    fields = {k: {"title": T.term_list(t), "body": T.term_list(b)} for k, (t, b) in docs.items()}
    avg = {f: sum(len(d[f]) for d in fields.values()) / 3 for f in ("title", "body")}
    for k, d in fields.items():
        score = 0.0
        for term in set(T.term_list("ledger notes")):
            df_ = sum(any(term in x[f] for f in x) for x in fields.values())
            tf = sum(w * d[f].count(term) / (0.25 + 0.75 * len(d[f]) / avg[f]) for f, w in (("title", 3.0), ("body", 1.0)))
            score += math.log(1 + (3 - df_ + 0.5) / (df_ + 0.5)) * 2.2 * tf / (1.2 + tf)
        assert got.get((1, k), 0.0) == pytest.approx(round(score, 6), abs=2e-6)
    assert not any(q == 2 for q, _ in got)


def test_fusion_orders_and_protection(spark):
    rows = [(1, "x", k, r) for r, k in enumerate("abcd", 1)] + [(1, "y", k, r) for r, k in enumerate("dcba", 1)]
    df = spark.createDataFrame(rows, "q long, ranking string, key string, rank int")
    fused = [r["key"] for r in fusion.fused(df, "q", "key").orderBy("rank").collect()]
    score = {k: 1 / (60 + "abcd".index(k) + 1) + 1 / (60 + "dcba".index(k) + 1) for k in "abcd"}
    assert fused == sorted("abcd", key=lambda k: (-round(score[k], 12), k))
    kept = [r["key"] for r in fusion.protected(df.where("ranking = 'y'"), df, "q", "key", keep=2).orderBy("rank").collect()]
    assert kept[:2] == ["d", "c"] and sorted(kept) == list("abcd")
    both = [r["key"] for r in fusion.diverse_protected([df.where("ranking = 'x'"), df.where("ranking = 'y'")], df, "q", "key", keep=1).orderBy("rank").collect()]
    assert both[:2] == ["a", "d"]
    twice = spark.createDataFrame([(1, "x", "a", 1), (1, "x", "a", 2), (1, "x", "b", 3)], "q long, ranking string, key string, rank int")
    assert {r["key"]: r["score"] for r in fusion.fused(twice, "q", "key").collect()} == {"a": round(1 / 61, 12), "b": round(1 / 62, 12)}
    dup = spark.createDataFrame([(1, "x", "a", 1), (1, "x", "a", 2), (1, "x", "b", 3)], "q long, ranking string, key string, rank int")
    assert sorted((r["key"], r["rank"]) for r in fusion.first_ranks(dup, "q", "key").collect()) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("hot", [10**9, 3])
def test_positions_agree_for_hot_groups(spark, hot):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.6 else 2, i, rng.choice([None, 0.0, 1.0, 2.5])) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, i long, s double")
    got = {r["i"]: r["s"] for r in positions.mid_ranks(df, "g", ["s"], hot).collect()}
    for g, i, s in rows:
        values = sorted(x for h, _, x in rows if h == g and x is not None)
        want = 0.5 if s is None else (values.index(s) + (values.count(s) + 1) / 2 - 0.5) / len(values)
        assert got[i] == pytest.approx(want)
    numbered = positions.number_rows(df, "g", [F.col("s").desc_nulls_last(), F.col("i")], "n", hot).collect()
    for g in (1, 2):
        want = [i for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))]
        assert [r["i"] for r in sorted((r for r in numbered if r["g"] == g), key=lambda r: r["n"])] == want


def test_walk_conserves_and_never_buries_a_hit(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, "link"), ("b", "c", 0.5, "co-use"), ("a", "b", 1.0, "co-use"), ("c", "c", 1.0, "link")], "src string, dst string, weight double, kind string")
    pairs = graph.merged(edges)
    assert sorted((r["a"], r["b"], r["kind"]) for r in pairs.collect()) == [("a", "b", "link"), ("b", "c", "co-use")]
    flow = graph.shares(graph.adjacency(pairs))
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id long, node string, amount double")
    got = {r["node"]: r["walk"] for r in graph.walk(seeds, flow, 2).collect()}
    assert got["b"] == pytest.approx(0.5) and got["a"] == pytest.approx(0.25 * 2 / 3) and got["c"] == pytest.approx(0.25 / 3)
    scores = {r["node"]: r["score"] for r in graph.blend(seeds, graph.walk(seeds, flow, 3)).collect()}
    assert scores["a"] >= 1.0 and scores["b"] <= 0.4 and scores["c"] <= 0.4


def test_links_outside_code_only(spark):
    body = "See [[One]] and `[[Two]]`.\n```\n[[Three]]\n```\n- supplies [[Four]] (ambiguous)\n- supplies [[four]] (extracted)\n<!-- [[Five]] -->"
    notes = spark.createDataFrame([("n", body), ("m", None), ("e", "")], "path string, body string")
    assert sorted(r["name"] for r in graph.wiki_links(notes, "path", "body").collect()) == ["four", "one"]
    typed = graph.typed_links(notes, "path", "body").collect()
    assert [(r["relation"], r["name"], r["weight"]) for r in typed] == [("supplies", "four", 1.0)]
    ids = spark.createDataFrame([("one", "a"), ("one", "b"), ("four", "c")], "name string, path string")
    assert [tuple(r) for r in graph.resolve(graph.wiki_links(notes, "path", "body"), ids, "path").collect()] == [("n", "c")]


def test_co_use_counts_repeats(spark):
    touches = [("s", "a"), ("s", "b"), ("s", "a"), ("t", "b"), ("t", "a")]
    df = spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate(touches)], "s string, n string, i long")
    want: dict = {}
    seen: dict = {}
    for s, n in touches:
        for other in seen.setdefault(s, []):
            if other != n:
                want[tuple(sorted((n, other)))] = want.get(tuple(sorted((n, other))), 0) + 1
        if n not in seen[s]:
            seen[s].append(n)
    assert {(r["a"], r["b"]): r["w"] for r in graph.co_use(df, "s", "n", "i").collect()} == want


def _events(spark, rows):
    return spark.createDataFrame(rows, "user long, ordinal long, kind string, note string, valence double")


def test_strength_fold(spark):
    rows = [(1, 0, "touch", "a", 0.0), (1, 1, "recall", "a", None), (1, 2, "outcome", None, -1.0), (1, 3, "tick", None, 0.0), (2, 0, "recall", "a", 0.0), (2, 1, "encode", "b", 0.9), (2, 2, "pin", "a", 1.0), (2, 3, "supersede", "b", 0.0)]
    got = {(r["user"], r["note"]): r for r in ledger.strengths(_events(spark, rows), "user").collect()}
    # used once: 0.3 + 0.04; a recall then raises the ceiling by 0.01; the outcome captures 0.5; a tick decays
    assert got[1, "a"]["strength"] == pytest.approx(round(min(0.35 + 0.5, 0.85) * 0.98, 4))
    assert got[1, "a"]["captured"] == pytest.approx(0.49)
    ticks = ledger.StrengthFold()
    ticks.apply("touch", "a", 0.0)
    ticks.apply("outcome", None, 0.7)
    for _ in range(3):
        ticks.apply("tick", None, 0.0)
    assert ticks.entries["a"]["captured"] == 0.3294
    assert got[2, "a"]["strength"] == 0.5
    assert got[2, "b"]["strength"] == pytest.approx(round((0.34 + 0.27) * 0.25, 4))


def test_debounce_counts_from_the_last_kept(spark):
    times = [0, 30, 59, 60, 119, 121, 500]
    df = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(times)] + [(2, 9, 10.0)], "k long, i long, t double")
    kept = sorted((r["k"], r["t"]) for r in ledger.debounced(df, ["k"], F.col("t"), "i").collect())
    assert kept == [(1, 0.0), (1, 60.0), (1, 121.0), (1, 500.0), (2, 10.0)]


def test_captures_take_twelve_latest(spark):
    rows = [(1, i, "touch", f"n{i % 15}", 0.0) for i in range(20)] + [(1, 20, "outcome", None, 1.0), (1, 21, "outcome", None, 0.1)]
    got = ledger.captures(_events(spark, rows), "user").collect()
    latest = [f"n{i % 15}" for i in range(19, -1, -1)]
    assert [r["note"] for r in sorted(got, key=lambda r: r["rank"])] == list(dict.fromkeys(latest))[:12]


def test_sessions_of_hot_actors(spark):
    import datetime

    rng, t0 = random.Random(9), datetime.datetime(2026, 1, 1)
    rows = [(1 if rng.random() < 0.7 else 2, i, t0 + datetime.timedelta(seconds=rng.choice([0, 100, 1800, 1801, 5000]) + i * 700)) for i in range(80)]
    df = spark.createDataFrame(rows, "u long, i long, ts timestamp")
    want = {}
    for u in (1, 2):
        last, n = None, 0
        for _, i, t in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            n += last is None or (t - last).total_seconds() > 1800
            last, want[i] = t, n
    for hot in (10**9, 5):
        assert {r["i"]: r["session"] for r in ledger.sessions(df, "u", "ts", "i", hot_rows=hot).collect()} == want


def test_entities_are_named_for_certain(spark):
    from quillmesh.operators import routing

    notes = spark.createDataFrame([("a.md", "Ada Lovelace", "person"), ("b.md", "Grace Hopper", "person"), ("c.md", "Grace Murray", "person"), ("d.md", "Acme Labs", "company"), ("e.md", "Twin Name", "person"), ("f.md", "Twin Name", "person"), ("g.md", None, "person"), ("h.md", "Odd Note", "note")], "path string, title string, note_type string")
    asked = ["ask ada lovelace", "did Lovelace come", "did Byron Lovelace come", "and grace came", "Grace Hopper", "the labs of Acme", "twin name", "odd note", None, ""]
    cues = spark.createDataFrame(list(enumerate(asked)), "q long, t string")
    got: dict = {}
    for r in routing.eligible_entities(notes, cues, "q", "t", ("person", "company")).collect():
        got.setdefault(r["q"], set()).add(r["path"])
    assert got == {0: {"a.md"}, 1: {"a.md"}, 4: {"b.md"}, 5: {"d.md"}}


def test_feedback_clusters_against_a_model(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel".split()
    rng = random.Random(3)
    rows = [(rng.choice(["Code", "code ", None]), rng.choice([1, -1]), " ".join(rng.sample(words, 3)), f"s{i % 4}", float(i // 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "domain string, polarity int, text string, session string, ts double")
    got = {(r["domain"], r["polarity"], r["cluster"]): (r["count"], r["sessions"]) for r in learning.feedback_clusters(df).collect()}
    want: dict = {}
    made: dict = {}
    for domain, p, text, s, ts in sorted(((("general" if r[0] is None else "code"), *r[1:]) for r in rows), key=lambda r: (r[0], r[1], r[4], r[2], r[3])):
        t = {x for x in T.term_list(text) if len(x) > 2}
        clusters = made.setdefault((domain, p), [])
        home = next((c for c in clusters if len(c["t"] & t) >= 2), None)
        if home is None:
            home = {"t": set(), "n": 0, "s": set()}
            clusters.append(home)
        home["t"] |= t
        home["n"] += 1
        home["s"].add(s)
    for (domain, p), clusters in made.items():
        for i, c in enumerate(clusters):
            want[domain, p, i] = (c["n"], len(c["s"]))
    assert got == want
    assert learning.feedback_clusters(df.limit(0)).count() == 0


def test_ledger_union(spark):
    df = spark.createDataFrame([("x", "l1", 2.0), ("x", "l1", 1.0), ("y", "a", 1.0), ("y", "b", 1.0)], "id string, line string, ts double")
    got = {r["id"]: (r["line"], r["copies"], r["conflict"]) for r in merging.union_identified(df, "id", [F.col("ts")], F.col("line")).collect()}
    assert got == {"x": ("l1", 2, False), "y": ("a", 2, True)}
    with pytest.raises(ValueError):
        merging.union_identified(df, "id", [F.col("ts")], F.col("line"), refuse=True)
    assert merging.union_identified(df.where("id = 'x'"), "id", [F.col("ts")], F.col("line"), refuse=True).count() == 1
    lines = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (2, 0, "c"), (2, 1, "a"), (3, 0, "0")], "r int, o int, l string")
    assert merging.legacy_order(lines, "r", "o", "l") == [("0", 1), ("b", 1), ("c", 1), ("a", 1), ("a", 2)]
    for bad in (lambda: merging.legacy_order(lines.union(spark.createDataFrame([(4, 0, "a"), (4, 1, "b")], lines.schema)), "r", "o", "l"), lambda: merging.legacy_order(lines, "r", "o", "l", most=3)):
        with pytest.raises(ValueError):
            bad()
    rep = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "r int, l string")
    assert sorted((r["l"], r["occurrence"]) for r in merging.union_legacy(rep, "r", "l").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_transcripts(spark):
    text = "user: Fix  it\nnow\n\nassistant: ok\n\nuser: <tag>\n\nuser: token = abcdef123"
    turns = merging.transcript_turns(spark.createDataFrame([(1, text), (2, None)], "d long, t string"), "d", "t")
    assert [(r["turn"], r["role"]) for r in turns.orderBy("turn").collect()] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "user")]
    assert [tuple(r) for r in merging.episodes(turns, "d").collect()] == [(1, 2, "Fix it now\n[scrubbed]")]


def test_cues_of_a_question(spark):
    rows = [(1, 'Where does "the blue door" lead, and who painted port 7433?'), (2, ""), (3, None), (4, "one two\nthree four; three four and five six seven eighth ninth"), (5, "Ledger ledgers")]
    got: dict = {}
    for r in recall.cues(spark.createDataFrame(rows, "q long, text string"), "q", "text").orderBy("q", "n").collect():
        got.setdefault(r["q"], []).append((r["cue"], r["weight"], r["origin"]))
    assert got[1][0] == (rows[0][1], 1.0, "query") and ("the blue door", 0.9, "quote") in got[1]
    assert ("who painted port 7433?", 0.7, "clause") not in got[1] and ("painted port 7433", 0.7, "clause") not in got[1] and ("who painted port 7433", 0.7, "clause") in got[1]
    assert any(o == "rare" for _, _, o in got[1])
    assert 2 not in got and 3 not in got and got[5] == [("Ledger ledgers", 1.0, "query")]
    assert [c for c, _, o in got[4] if o == "clause"] == ["one two", "three four", "five six seven eighth ninth"]
    assert [c for c, _, o in got[4] if o == "rare"] == ["seven eighth ninth", "three"]
    assert recall.cues(spark.createDataFrame(rows, "q long, text string"), "q", "text", limit=2).where("n >= 2").count() == 0


def test_choice_by_coverage(spark):
    rows = [(1, f"p{i}", 1.0 - i / 100, f" Title{i % 7} " if i % 2 else f"title{i % 7}", [f"f{i % 5}"] if i else []) for i in range(30)]
    df = spark.createDataFrame(rows, "q long, path string, score double, title string, facets array<string>")

    def model(k):
        taken, seen, titles = [], set(), set()
        for i, (_, _, _, t, f) in enumerate(rows):
            if len(taken) < k and (not i or set(f) - seen):
                taken.append(i)
                titles.add(t.strip().lower())
            seen |= set(f)
        for i, (_, _, _, t, _) in enumerate(rows):
            if len(taken) < k and i not in taken and t.strip().lower() not in titles:
                taken.append(i)
                titles.add(t.strip().lower())
        return [rows[i][1] for i in sorted(taken)]

    for k in (1, 3, 8, 20):
        for pool in (50, None):
            assert [r["path"] for r in recall.cover_select(df, "q", "path", k, pool).orderBy("position").collect()] == model(k), (k, pool)


def test_excerpt_grows_around_the_definition():
    text = "\n".join(f"x = {i}" for i in range(30)) + "\ndef load_ledger():\n    return 1\n"
    a, b = recall.excerpt(text, set(T.term_list("load ledger")), [("load_ledger", 31)], 40)
    assert recall.excerpt("a b\nc d\ne f", set(), [], 1) == (1, 1) and recall.excerpt("q\nw\ne\nr\nt", set(), [], 1, frozenset([3])) == (2, 3)
    assert recall.excerpt("x" * 900, set(), [], 10) == (1, 1)
    assert a <= 31 <= b and sum(len(line) + 1 for line in text.split("\n")[a - 1 : b]) <= 160


def test_extraction_never_fails_a_table(spark):
    files = [("a.py", "def f(x):\n    '''Doc.'''\n    return g(x)\nclass C:\n    def m(self): pass\nimport os"), ("b.py", "def ("), ("c.json", '{"a": {"b": 1}}'), ("d.md", "# T\ntext [[X]]\n## U\n"), ("e.sql", "create table t (id int, o int references u);"), ("f.txt", "x"), ("g.py", None), ("h.yaml", "a:\n  b: 1\n"), ("i.toml", "[t]\nk = 1\n")]
    df = spark.createDataFrame(files, "path string, text string")
    got = extract.facts(df, "path", "path", "text").collect()
    labels = {(r["path"], r["label"]) for r in got if r["part"] == "node"}
    assert {("a.py", "f"), ("a.py", "C.m"), ("c.json", "a.b"), ("d.md", "U"), ("e.sql", "t.o"), ("h.yaml", "a.b"), ("i.toml", "t.k")} <= labels
    assert ("f", "calls", "g") in {(r["label"], r["kind"], r["other"]) for r in got if r["part"] == "link"}
    assert not any(r["path"] in ("b.py", "f.txt", "g.py") for r in got)


def test_extraction_of_more_forms(spark):
    files = [
        ("a.py", "# Says what\n# it does.\ndef helper(): pass\nclass Base: pass\nclass C(Base):\n    def go(self):\n        self.run(); helper()\n    def run(self): pass\n"),
        ("b.js", "/** Loads. */\nexport function load(a) { return parse(a) /* gone(1) */ }\nclass Xa extends Ya {\n  m() {}\n}\n"), ("c.java", "class Ab implements Bc {\n  int x;\n}\n"), ("d.rs", "pub fn start() { stop(); }\nimpl Thing {}\n"), ("e.md", "Top\n===\ntext [a](b.md#x) [w](https://x.example)\nSub\n---\n"),
        ("f.sql", "CREATE OR REPLACE VIEW v AS SELECT * FROM t JOIN u ON 1=1; -- create table no (x int)\nCREATE TEMP TABLE t (id int, n numeric(3, 2), PRIMARY KEY (id))"), ("g.toml", "[[dep]]\nname = 'a'\n[[dep]]\nname = 'b'\n"), ("h.yaml", "- name: x\n  run: |\n    not: key\n  'q k': 1\n"), ("i.rst", "Head\n====\n\nSee :ref:`the thing <x>` and ``code``.\n"),
        ("package-lock.json", "{\"a\": 1}"), ("x.min.js", "function f() {}"), (".hid.py", "def f(): pass"), ("n.py", "def f(): pass\x00"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    rows = extract.facts(df, "path", "path", "text").collect()
    nodes = {(r["path"], r["label"], r["kind"]): r["body"] for r in rows if r["part"] == "node"}
    links = {(r["path"], r["label"], r["kind"], r["other"]) for r in rows if r["part"] == "link"}
    assert nodes["a.py", "helper", "function"] == "Says what it does." and {("a.py", "C", "inherits", "Base"), ("a.py", "C.go", "calls", "C.run"), ("a.py", "C.go", "calls", "helper")} <= links
    assert nodes["b.js", "load", "function"] == "Loads." and {("b.js", "load", "calls", "parse"), ("b.js", "", "exports", "load"), ("b.js", "Xa", "inherits", "Ya"), ("c.java", "Ab", "inherits", "Bc"), ("d.rs", "start", "calls", "stop")} <= links and not any(x[3] == "gone" for x in links)
    assert {("e.md", "Top", "heading"), ("e.md", "Sub", "heading"), ("f.sql", "v", "view"), ("f.sql", "t.n", "column"), ("g.toml", "dep[1].name", "key"), ("h.yaml", "name", "key"), ("h.yaml", "q k", "key"), ("d.rs", "Thing", "impl")} <= set(nodes)
    assert ("e.md", "Top", "references", "b.md") in links and ("f.sql", "v", "references", "u") in links and ("h.yaml", "run.not", "key") not in nodes and ("f.sql", "no", "table") not in nodes and nodes["i.rst", "Head", "heading"] == "See the thing and code."
    assert not {p for p, *_ in nodes} & {"package-lock.json", "x.min.js", ".hid.py", "n.py"}
    assert {tuple(r)[1:] for r in extract.symbol_relations(extract.facts(df, "path", "path", "text"), "path").where("path = 'a.py'").collect()} == {("C::go", "calls", "C::run"), ("C::go", "calls", "helper"), ("C", "inherits", "Base")}
    many = spark.createDataFrame([("m.py", "\n".join(f"def f{i:03d}(): pass" for i in range(300)))], "path string, text string")
    assert extract.facts(many, "path", "path", "text").count() == 200 and extract.facts(many, "path", "path", "text", None).count() == 300


def test_relation_answers(spark):
    typed = spark.createDataFrame([("people/ada", "works-at", "companies/acme"), ("companies/acme", "founder of", "people/ada"), ("people/lin", "attended", "meetings/review"), ("people/ada", "likes", "people/lin")], "path string, relation string, target string")
    types = spark.createDataFrame([("people/ada", "person"), ("people/lin", "person"), ("companies/acme", "company"), ("meetings/review", "meeting")], "path string, type string")
    table = relations.edges(typed, types)
    ids = spark.createDataFrame([("acme", "companies/acme"), ("review", "meetings/review"), ("two", "a"), ("two", "b")], "name string, path string")
    ask = lambda q: [r["path"] for r in relations.hits(table, ids, relations.parse(q)).collect()]
    assert ask("Who works at Acme?") == ["people/ada"]
    assert ask("Who attended review?") == ["people/lin"]
    assert ask("Who founded two?") == []
    assert relations.parse("Who founded Acme and who left?") is None


def test_session_metrics(spark):
    rows = [("s", "recall", "a"), ("s", "touch", "a"), ("s", "recall", "b"), ("s", "encode", "c"), ("t", "recall", "a")]
    got = {r["session"]: tuple(r)[1:] for r in learning.session_metrics(spark.createDataFrame(rows, "session string, kind string, note string"), "session").collect()}
    assert got == {"s": (2, 2, 1, 1, 1), "t": (1, 0, 0, 0, 1)}


def test_symbol_scores_prefer_exact_names(spark):
    labels = spark.createDataFrame([("a.py", "load"), ("b.py", "loader"), ("c.py", "reload"), ("d.py", "x")], "f string, l string")
    got = {r["f"]: r["score"] for r in lexical.symbol_scores(labels, "f", "l", spark.createDataFrame([(1, "load")], "q long, t string"), "q", "t").collect()}
    assert got["a.py"] > got["b.py"] > got["c.py"] and "d.py" not in got


def test_complete_ranking_is_a_permutation(spark):
    universe = spark.createDataFrame([(1, k) for k in "abcd"], "q long, key string")
    ranking = spark.createDataFrame([(1, "c", 1), (1, "a", 2)], "q long, key string, rank int")
    assert [r["key"] for r in fusion.complete(ranking, universe, "q", "key").orderBy("rank").collect()] == ["c", "a", "b", "d"]


def test_routes_and_providers(spark):
    from quillmesh.operators import routing

    asked = [(["command", "failure_excerpt", "path"], "trace"), (["x"], "general"), ([], "general"), (["anchor_diff", "anchor_file"], "ripple"), (["review_comment", "path"], "comment"), (["review_comment"], "general"), (["implementation_files"], "code"), (["command"], "general")]
    routes = spark.createDataFrame(asked, "parts array<string>, want string").select("want", routing.route_of(F.col("parts")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in routes) and len(routes) == len(asked)
    qs = spark.createDataFrame([(1, "b.py", None, "see `src/A.py`, and src/a.py."), (2, None, None, "")], "q long, x string, y string, t string")
    paths = spark.createDataFrame([("src/a.py",), ("b.py",)], "path string")
    assert [(r["q"], r["anchor"]) for r in routing.anchors_of(qs, "q", ["x", "y"], "t", paths, "path").orderBy("q", "n").collect()] == [(1, "b.py"), (1, "src/a.py")]
    rows = [(1, "semantic", k, r) for r, k in enumerate("abc", 1)] + [(1, "current", k, r) for r, k in enumerate("cba", 1)]
    df = spark.createDataFrame(rows, "q long, ranking string, key string, rank int")
    assert [r["key"] for r in routing.routed(df, "q", "key", "comment").orderBy("rank").collect()][:2] == ["a", "b"]
    own = spark.createDataFrame([("a.py", "b.py"), ("a.go", "b.go")], "src string, dst string")
    ext = spark.createDataFrame([("a.go", "c.go"), ("a.go", "zz.go")], "src string, dst string")
    known = spark.createDataFrame([("a.py",), ("b.py",), ("a.go",), ("b.go",), ("c.go",)], "path string")
    assert {tuple(r) for r in routing.provided(own, ext, ["go"], known).collect()} == {("a.py", "b.py", "internal"), ("a.go", "c.go", "external")}


def test_inferred_layer(spark):
    from quillmesh.operators import routing

    reply = '{"concepts":[{"label":"Big idea","members":["h1","h9"]}],"edges":[{"source":"h1","target":"h2","relation":"Relates To"},{"source":"h1","target":"h1","relation":"x"},{"source":"h2","target":"h1","relation":"y"}]}'
    handles = spark.createDataFrame([("h1", "a"), ("h2", "b")], "handle string, id string")
    got = routing.inferred_layer(spark.createDataFrame([(reply,), ("no json",)], "reply string"), handles, spark.createDataFrame([("b", "a")], "source string, target string")).collect()
    assert {(r["source"], r["target"], r["relation"]) for r in got} == {("a", "b", "relates_to"), ("concept:big-idea", "a", "groups")}
