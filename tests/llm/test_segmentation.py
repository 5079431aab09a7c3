import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm.segmentation import cohesion, pieces, split_text, units, valley_depths


def _check(text, limit):
    spans = split_text(text, limit)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d
    assert len(spans) == 1 or all(len(text[a:b].encode()) <= limit * 4 for a, b in spans)
    rebuilt = text[: spans[0][1]] + "".join(text[max(a, p[1]) : b] for p, (a, b) in zip(spans, spans[1:]))
    assert rebuilt == text
    return spans


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é日\n ;"), max_size=60), max_size=40))
def test_pieces_cover_and_fit(parts):
    _check("\n".join(parts), 30)


def test_overlap_is_two_lines_or_forty_characters():
    text = "".join(f"line {i} of the text with some words\n" for i in range(300))
    for (a, b), (c, _) in zip(_check(text, 200), _check(text, 200)[1:]):
        assert text.count("\n", c, b) == 2 and text[c - 1] == "\n"
    long = "x" * 9000
    for (_, b), (c, _) in zip(split_text(long), split_text(long)[1:]):
        assert b - c == 40


def test_cuts_at_the_topic_change():
    first = [f"ledger replay event clock {i}" for i in range(12)]
    second = [f"kitchen recipe onion butter {i}" for i in range(12)]
    depths = valley_depths(first + second)
    assert max(range(3, 22), key=lambda i: depths[i]) == 12


def test_cohesion_against_a_model():
    rng = random.Random(2)
    parts = [" ".join(rng.choice(["amber", "belfry", "charter", "docket", "ember"]) for _ in range(rng.randint(0, 5))) for _ in range(40)]
    got = cohesion(parts, 4)
    for i in range(1, 40):
        a, b = Counter(" ".join(parts[max(0, i - 4) : i]).split()), Counter(" ".join(parts[i : i + 4]).split())
        norm = math.sqrt(sum(c * c for c in a.values()) * sum(c * c for c in b.values()))
        assert abs(got[i] - (sum(c * b[w] for w, c in a.items()) / norm if norm else 0)) < 1e-12


def test_long_lines_are_cut_between_sentences_where_the_topic_changes():
    first = "".join(f"The ledger replays every event of clock number {i} once more. " for i in range(35))
    second = "".join(f"Some kitchen recipe wants onion with butter, portion {i} again. " for i in range(35))
    text = first + second  # one line
    spans = _check(text, 800)
    assert spans[0][1] == len(first) and spans[0][1] - spans[1][0] == 40
    # A paragraph a line, each more than half of a piece: lines end no piece in its window, sentences do.
    paragraphs = [first[:2000].rsplit(". ", 1)[0] + ".", second[:2000].rsplit(". ", 1)[0] + "."] * 2
    for a, b in _check("\n".join(paragraphs), 400)[:-1]:
        assert "\n".join(paragraphs)[b - 2 : b] in (". ", ".\n") or "\n".join(paragraphs)[b - 1] == "\n"
    parts, ends = units(["short. line\n", first + "\n", "x;" * 400])
    assert "".join(parts) == "short. line\n" + first + "\n" + "x;" * 400 and sum(ends) == 3 and len(parts) > 30


def test_tables(spark):
    rows = [(1, "short\ntext", 5), (2, "a b c\n" * 1000, 10), (3, None, 1), (4, "", 1), (5, "x" * 4000, None), (1, "short\ntext", 5)]
    df = spark.createDataFrame(rows, "excerpt_id long, text string, start_line int").selectExpr("*", "7 AS piece")
    got = pieces(df, "excerpt_id", "text", "start_line").collect()
    by = {}
    for r in got:
        by.setdefault(r["excerpt_id"], []).append(r)
    assert set(by) == {1, 2, 4, 5}
    assert [(r["start_line"], r["end_line"]) for r in by[1]] == [(5, 6), (5, 6)]
    two = sorted(by[2], key=lambda r: r["piece"])
    assert two[0]["start_line"] == 10 and two[-1]["end_line"] == 1009 and all(r["tokens"] <= 800 for r in two)
    assert all(b["start_line"] == a["end_line"] - 1 for a, b in zip(two, two[1:]))
    assert {(r["start_line"], r["end_line"]) for r in by[5]} == {(1, 1)}
    assert pieces(df.limit(0), "excerpt_id", "text", "start_line").count() == 0
