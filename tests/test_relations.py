"""Questions, statements and answers about people and organisations."""

import pytest

from quillmesh.operators import graph, relations
from quillmesh.operators.relations import Request, parse, stated

ASKED = {
    "Who works at Acme?": ("acme", "works_at", "in", "", ""), "Who used to work at Acme?": ("acme", "works_at", "in", "", "past"), "Who currently works for Acme?": ("acme", "works_at", "in", "", "current"), "Who founded Acme Corp?": ("acme corp", "founded", "in", "", ""),
    "Who are the founders of Acme?": ("acme", "founded", "in", "", ""), "Which people attended the spring review?": ("spring review", "attended", "in", "", ""), "Who backed Acme?": ("acme", "invested_in", "in", "", ""), "Who has invested in Acme?": ("acme", "invested_in", "in", "", ""),
    "What did Ada Lovelace found?": ("ada lovelace", "founded", "out", "", ""), "Which companies has Ada invested in?": ("ada", "invested_in", "out", "", ""), "Where does Ada work?": ("ada", "works_at", "out", "", ""), "Which meetings did Ada attend?": ("ada", "attended", "out", "", ""),
    "Who does Ada advise?": ("ada", "advises", "out", "", ""), "Who is the CEO of Acme?": ("acme", "works_at", "in", "ceo", ""), "who was the former chief technology officer of Acme": ("acme", "works_at", "in", "cto", "past"), "Acme's investors": ("acme", "invested_in", "in", "", ""),
    "Who is Ada's current employer?": ("ada", "works_at", "out", "", "current"), "For Acme, who founded it?": ("acme", "founded", "in", "", ""), "List the advisers to Acme.": ("acme", "advises", "in", "", ""), "What company is Ada working at?": ("ada", "works_at", "out", "", ""),
}


@pytest.mark.parametrize("question", ASKED)
def test_questions(question):
    r = parse(question)
    assert r is not None and (r.seed, r.relation, r.direction, r.qualifier, r.tense) == ASKED[question]
    assert r.answer[0] in ("person", "company", "meeting", "fund") and ("person" in r.answer) == (r.direction == "in")


@pytest.mark.parametrize("question", ["", "Who founded Acme and who left?", "How do ledgers replay?", "Who founded Acme? Who left?", "What is the port of the database?", "who " * 130])
def test_no_request(question):
    assert parse(question) is None


SAID = {
    "[[Ada]] founded [[Acme]].": {("Ada", "founded", "Acme", "", "")}, "[[Acme]] was founded by [[Ada]] and [[Lin]].": {("Ada", "founded", "Acme", "", ""), ("Lin", "founded", "Acme", "", "")}, "[[Ada]], [[Lin]] and [[Sam]] attended the [[Review]].": {(n, "attended", "Review", "", "") for n in ("Ada", "Lin", "Sam")},
    "[[Ada]] is the CEO of [[Acme]].": {("Ada", "works_at", "Acme", "ceo", "")}, "[[Ada]] formerly worked at [[Acme]].": {("Ada", "works_at", "Acme", "", "past")}, "[[Ada]] no longer works at [[Acme]].": {("Ada", "works_at", "Acme", "", "past")}, "[[Lin]] met us. She advises [[Acme]].": {("Lin", "advises", "Acme", "", "")},
    "He invested in [[Acme]] and [[Beta]].": {("me", "invested_in", "Acme", "", ""), ("me", "invested_in", "Beta", "", "")}, "- [[Ada]] joined [[Acme]] as chief technology officer.": {("Ada", "works_at", "Acme", "cto", ""), ("Ada", "attended", "Acme", "", "")}, "[[Ada]] is an investor in [[Acme]].": {("Ada", "invested_in", "Acme", "", "")},
}


@pytest.mark.parametrize("text", SAID)
def test_statements(text):
    assert set(stated(text, "me")) == SAID[text]


@pytest.mark.parametrize(
    "text",
    [
        "Did [[Ada]] found [[Acme]]?", "[[Ada]] did not found [[Acme]].", "[[Ada]] might have founded [[Acme]].", "If [[Ada]] founded [[Acme]], we would know.", "\"[[Ada]] founded [[Acme]],\" it read.", "> [[Ada]] founded [[Acme]].",
        "According to Sam, [[Ada]] founded [[Acme]].", "Sam said [[Ada]] founded [[Acme]].", "[[Ada]] never worked at [[Acme]].", "[[Ada]] wants to invest in [[Acme]].", "[[Ada]] and [[Acme]] are links.", "[[Ada]] founded. Then [[Acme]] grew.", "",
    ],
)
def test_what_states_nothing(text):
    assert stated(text, "me") == []


def test_answers(spark):
    notes = spark.createDataFrame(
        [("people/ada.md", "Ada", "She founded [[Acme]]. `[[Ada]] founded [[Beta]]`\n- works-at [[Beta]]"), ("people/lin.md", "Lin", "[[Lin]] formerly worked at [[Acme]]. [[Lin]] is the CTO of [[Beta]]."), ("companies/acme.md", "Acme", "- founder of [[Ada]]\nThe [[Review]] was attended by [[Lin]]."), ("companies/beta.md", "Beta", None), ("meetings/review.md", "Review", "")],
        "path string, title string, body string",
    )
    types = notes.selectExpr("path", "CASE WHEN path LIKE 'people%' THEN 'person' WHEN path LIKE 'meet%' THEN 'meeting' ELSE 'company' END AS type")
    names = graph.identities(notes, notes.limit(0))
    typed = graph.typed_links(notes, "path", "body").join(names, "name").select("path", "relation", "target")
    said = relations.named_ends(relations.from_prose(notes, "path", "body"), names)
    table = relations.edges(typed, types, said)
    got = {(r["subject"][7:-3], r["relation"], r["object"].split("/")[1][:-3], r["qualifier"], r["tense"]) for r in table.collect()}
    assert got == {("ada", "founded", "acme", "", ""), ("ada", "works_at", "beta", "", ""), ("lin", "works_at", "acme", "", "past"), ("lin", "works_at", "beta", "cto", ""), ("lin", "attended", "review", "", "")}
    ids = names.withColumnRenamed("target", "path")
    qs = spark.createDataFrame([(1, "Who works at Beta?"), (2, "Who used to work at Acme?"), (3, "Who is the CTO of Beta?"), (4, "Who currently works at Acme?"), (5, "Where does Ada work?"), (6, "Which meetings did Lin attend?"), (7, "nothing"), (8, None), (9, "Which funds has Ada invested in?"), (10, "Who founded Nobody?")], "q long, t string")
    found: dict = {}
    for r in relations.hits(table, ids, relations.requests(qs, "q", "t"), "q", types).collect():
        found.setdefault(r["q"], set()).add(r["path"].split("/")[1][:-3])
    assert found == {1: {"ada", "lin"}, 2: {"lin"}, 3: {"lin"}, 5: {"beta"}, 6: {"review"}}
    assert relations.hits(table, ids, Request("acme", "founded", "in")).columns == ["path", "ordinal"]
    assert relations.from_prose(notes.limit(0), "path", "body").count() == 0


def test_answers_stand_in_front(spark):
    ranked = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (2, "a", 1.0)], "q long, k string, score double")
    answers = spark.createDataFrame([(1, "c"), (1, "z"), (1, "b"), (3, "n")], "q long, k string")
    got: dict = {}
    for r in relations.answers_first(ranked, answers, "q", "k").orderBy("q", "score", ascending=[True, False]).collect():
        got.setdefault(r["q"], []).append((r["k"], r["answer"]))
    assert got == {1: [("b", True), ("c", True), ("z", True), ("a", False)], 2: [("a", False)], 3: [("n", True)]}
    v = relations.volunteered(ranked, answers, spark.createDataFrame([(1, "b")], "q long, k string"), "q", "k")
    assert {(r["q"], r["k"], r["rank"]) for r in v.collect()} == {(1, "c", 1), (1, "z", 2), (3, "n", 1)}
