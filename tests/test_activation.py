"""Links to notes and the complete scorer against small models."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import activation, graph


def test_links_lead_to_notes(spark):
    notes = spark.createDataFrame(
        [
            ("a/one.md", "First Thing", "See [[Second  Thing]], [[b/two.md|two]], [[b/two]], [[Twice]], [[old name]], [[space name]], [md](../b/two.md#x), ![pic](../b/two.md), `[[b/three.md]]`, ~~[[b/three.md]]~~ [ref]: x\n\n[r]: ../b/three.md\n- uses [[b/three.md]] (inferred)\n", None),
            ("b/two.md", "Second Thing", "[[First Thing]] [[Alias]] [x](https://a.example/b) [self](two.md)", None), ("b/three.md", "Twice", None, ["Alias"]), ("c/four.md", "Twice", "", None), ("d/old.md", "Old Name", "", None), ("e/space-name.md", "Other", "", None), ("f/old2.md", "Second Thing", "", None),
        ],
        "path string, title string, body string, aliases array<string>",
    )
    gone = spark.createDataFrame([("d/old.md",), ("f/old2.md",)], "path string")
    names = graph.identities(notes, gone)
    known = {r["name"]: r["target"] for r in names.collect()}
    assert known["second thing"] == "b/two.md" and known["old name"] == "d/old.md" and "twice" not in known and known["alias"] == "b/three.md"
    got = {(r["path"], r["target"]) for r in graph.resolve_links(graph.note_links(notes, "path", "body"), notes, names, "path").collect()}
    assert got == {("a/one.md", "b/two.md"), ("a/one.md", "d/old.md"), ("a/one.md", "e/space-name.md"), ("a/one.md", "b/three.md"), ("b/two.md", "a/one.md"), ("b/two.md", "b/three.md")}
    assert graph.note_links(notes.where("path = 'a/one.md'"), "path", "body").where("wiki = 'b/three.md'").count() == 0


def test_channels_are_bounded(spark):
    lex = spark.createDataFrame([(1, "a", 4.0), (1, "gone", 9.0), (1, "t", 2.0)], "q long, node string, amount double")
    lex = activation.damped(lex, spark.createDataFrame([("t",)], "node string"), "q")
    sem = activation.semantic(spark.createDataFrame([(1, "b", 1.0, 0.9), (1, "b", 0.5, 0.2), (2, "c", 1.0, 0.8), (1, "a", 1.0, 0.1)], "q long, node string, weight double, cosine double"), "q")
    terms = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z")], "q long, term string")
    learned = activation.associated(terms, spark.createDataFrame([("d", "x", 1.0), ("d", "y", 1.0), ("e", "x", 1.0)], "node string, term string, w double"), "q")
    got = {(r["q"], r["node"]): (round(r["amount"], 6), r["words"], r["top"]) for r in activation.seeds(lex, "q", spark.createDataFrame([("gone",)], "node string"), sem, learned).collect()}
    assert got[1, "a"] == (4.0, 4.0, 4.0) and got[1, "t"] == (1.0, 1.0, 4.0) and got[1, "gone"] == (9.0, 9.0, 4.0)
    assert got[1, "b"] == (1.2, 0.0, 4.0) and got[2, "c"] == (1.0, 0.0, 0.0) and got[1, "d"] == (0.25, 0.0, 4.0) and (1, "e") not in got
    low = spark.createDataFrame([(1, "a", 1.0)], "q long, node string, amount double")
    assert {r["node"]: round(r["amount"], 6) for r in activation.seeds(low, "q", None, sem).where("q = 1").collect()} == {"a": 1.0, "b": 0.4}


def _model(seed, words, adj, prior, strength, goal, waste, steps=3):
    top = max(words.values(), default=0.0)
    walk, best, frontier = {}, {}, dict(seed)
    for hop in range(1, steps + 1):
        new = {}
        for m in sorted(frontier):
            z = sum(w * prior[n] for n, w in adj.get(m, {}).items())
            for n, w in sorted(adj.get(m, {}).items()):
                share = frontier[m] * 0.5 * w * prior[n] / z
                if frontier[m] > 1e-9 and share > 1e-9:
                    new[n] = new.get(n, 0) + share
                    if share > best.get(n, (0,))[0]:
                        best[n] = (share, m, hop)
        for n, v in new.items():
            walk[n] = walk.get(n, 0) + v
        frontier = new
    out = {}
    for n in strength:
        d, w, k = seed.get(n, 0), walk.get(n, 0), words.get(n, 0)
        rel = d * (1 + (0.5 * w / (w + d) if w else 0)) if k else min(d + w, 0.4 * top) if top and (d or w) else d + w if d else None
        if rel is not None:
            out[n] = round(rel * (0.8 + 0.4 * min(1, strength[n])) * (1 + 0.3 * min(1, goal.get(n, 0))) * (0.8 if n in waste else 1), 6)
    return out, {n: (m, h) for n, (_, m, h) in best.items()}


def test_activation_against_a_model(spark):
    pairs = [("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 0.2), ("a", "d", 1.0), ("e", "f", 1.0)]
    adj: dict = {}
    for x, y, w in pairs:
        adj.setdefault(x, {})[y] = w
        adj.setdefault(y, {})[x] = w
    strength = dict(a=0.0, b=0.5, c=1.7, d=0.2, e=0.0, f=0.3, g=0.0)
    words, more = {"a": 2.0, "c": 0.5}, {"e": 0.3}
    goal, waste = {"b": 0.4, "a": 3.0}, {"c"}
    want, carried = _model(words | more, words, adj, {n: 0.25 + s for n, s in strength.items()}, strength, goal, waste)
    lex = spark.createDataFrame([(1, n, v) for n, v in words.items()], "q long, node string, amount double")
    sem = spark.createDataFrame([(1, n, v) for n, v in more.items()], "q long, node string, amount double")
    p = spark.createDataFrame(pairs, "a string, b string, weight double")
    s = spark.createDataFrame(list(strength.items()), "node string, strength double")
    g, w = spark.createDataFrame(list(goal.items()), "node string, goal double"), spark.createDataFrame([(n,) for n in waste], "node string")
    rows = activation.activate(activation.seeds(lex, "q", None, sem), p, "q", s, g, w, carriers=True)
    got = {r["node"]: r for r in rows.collect()}
    assert {n: r["score"] for n, r in got.items()} == pytest.approx(want)
    assert {n: (r["carrier"], r["hop"]) for n, r in got.items() if r["carrier"]} == {n: c for n, c in carried.items() if n in want}
    said = {r["node"]: r["why"] for r in activation.why(rows, "q").collect()}
    assert said["b"].startswith("via a in 1 step; score") and said["a"].startswith("words 2.000")
    plain = activation.activate(activation.seeds(lex, "q"), p, "q", steps=0)
    assert {r["node"]: r["score"] for r in plain.collect()} == {"a": 2.0, "c": 0.5}
    assert activation.activate(activation.seeds(lex.limit(0), "q"), p, "q", s).count() == 0
    alone = activation.activate(activation.seeds(lex, "q"), p.limit(0), "q", carriers=True).collect()
    assert {r["node"]: r["score"] for r in alone} == {"a": 2.0, "c": 0.5} and all(r["carrier"] is None for r in alone)
    assert activation.floored(s.where("node = 'b'"), spark.createDataFrame([("g",)], "node string")).agg(F.sum("strength")).first()[0] == 1.0
