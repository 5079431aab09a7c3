from quillmesh.llm import pii

TEXTS = [
    ("Spoke with Greta Lindqvist about it. Blue Harbor now drops files.", {"person_name"}),
    ("Call +1 (555) 010-2233 if it stays down.", {"phone"}),
    ("Their tax number is 951-76-1071, mail to anna.novak [at] example.com", {"id_number", "email"}),
    ("They moved to Flat 3A, 27 Tannergate Rd, Tannstead in spring.", {"address"}),
    ("Clone it from git@forge.example:harbor/tool.git and use postgres://reader@db.example/main", set()),
    ("Build 7.449.0176 took 132 209 bytes. Row 474-56-678 is a part number. Ticket 2026-08-8762.", set()),
    ("The counter went from 131345107 to 8940975175.", set()),
    ("signed off by K. OYELARAN", {"person_name"}),
    ("Per Petrov, Wim, the rule stays. Later Petrov, Wim agreed.", {"person_name"}),
    ("", set()),
]


def _lexicon():
    words = "spoke with about it now drops files call if stays down their tax number is mail to they moved in spring per the rule later agreed from use took went counter build row ticket signed off by".split()
    return pii.Lexicon(frozenset(words), frozenset(["blue", "harbor"]), frozenset(["blue harbor"]))


def test_kinds():
    lexicon = _lexicon()
    for text, want in TEXTS:
        assert {k for _, _, k in pii.find(text, lexicon)} == want, text


def test_placeholders_keep_the_rest():
    assert pii.replace("Call +44 7700 900804 if it stays down.", _lexicon()) == "Call [PHONE] if it stays down."
    text = "Nothing personal here."
    assert pii.replace(text, _lexicon()) == text


def test_held_out_grammar():
    lexicon = pii._training_lexicon()
    texts = pii.training_texts(300, seed=4242)
    right = sum({k for _, _, k in pii.find(t, lexicon)} == {k for _, _, k in spans} for t, spans in texts)
    assert right >= 0.98 * len(texts)


def test_repeats_agree():
    segs = pii.segments("SSN 951-76-1071 is on file.\n" + "x\n" * 50 + "951-76-1071", _lexicon())
    labels = pii.trained().label(segs)
    assert labels == [pii.LABELS.index("id_number")] * 2  # the bare one follows its twin over the skip edge


def test_tables(spark):
    rows = [(i, t, "clash") for i, (t, _) in enumerate(TEXTS)] + [(99, None, "x"), (1, TEXTS[1][0], "again")]
    df = spark.createDataFrame(rows, "row_id long, text string, kind string")
    lexicon = _lexicon()
    got = {(r["row_id"], r["kind"]) for r in pii.kinds_found(df, ["row_id"], "text", lexicon).collect()}
    assert got == {(i, k) for i, (_, ks) in enumerate(TEXTS) for k in ks}
    out = {r["row_id"]: r["text"] for r in pii.replaced(df, ["row_id"], "text", lexicon).collect()}
    assert out[99] is None and "[ADDRESS]" in out[3]
    assert pii.kinds_found(df.limit(0), ["row_id"], "text", pii.lexicon_of(df.limit(0), "text")).count() == 0


def test_lexicon_counts_documents(spark):
    df = spark.createDataFrame([("the Blue Harbor file, mail to rare@example.com",)] * 40 + [("Odd Name",)], "t string")
    lexicon = pii.lexicon_of(df, "t")
    assert "file" in lexicon.lower and "blue harbor" in lexicon.pairs and "odd name" not in lexicon.pairs and "rare" not in lexicon.lower


def test_frequency_alone_makes_no_service():
    lexicon = _lexicon()
    words, pairs = lexicon.words | {"greta", "lindqvist"}, lexicon.pairs | {"greta lindqvist", "lindqvist greta"}
    often, everywhere = pii.Lexicon(lexicon.lower, lexicon.words, pairs), pii.Lexicon(lexicon.lower, words, pairs)
    for text in ("Spoke with Greta Lindqvist about it.", "Per Lindqvist, Greta, the rule stays."):
        assert [k for _, _, k in pii.find(text, often)] == ["person_name"], text
    for text in ("signed off by Greta Lindqvist", "Spoke with Ms. Lindqvist about it.", "Per G. Lindqvist, the rule stays.", "signed off by Greta Lindqvist. Later Greta Lindqvist drops it."):
        assert {k for _, _, k in pii.find(text, everywhere)} == {"person_name"}, text
    for text in ("Blue Harbor now drops files.", "Spoke with Blue Harbor about it."):
        assert pii.find(text, everywhere) == [], text


def test_copies_make_no_service(spark, tmp_path):
    from quillmesh.llm import queries

    notes = [(i, f"Row {i} of the files stays, blue item{chr(97 + i % 26)}.") for i in range(80)] + [(100 + i, "Spoke with Greta Lindqvist about it.") for i in range(40)]
    spark.createDataFrame(notes, "note_id long, body string").write.parquet(f"{tmp_path}/notes.parquet")
    events = [(7, "Spoke with Wim Petrov about files.")] * 30 + [(8, None)]
    spark.createDataFrame(events, "event_id long, text string").write.parquet(f"{tmp_path}/feedback_events.parquet")
    want = {*(("notes", 100 + i, "person_name") for i in range(40)), ("feedback_events", 7, "person_name")}
    assert {tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()} == want
    out = {r["row_id"]: r["text"] for r in queries.p3_replaced(spark, str(tmp_path)).collect()}
    assert out[100] == "Spoke with [PERSON_NAME] about it." and out[7] == "Spoke with [PERSON_NAME] about files."


def test_pairs_beside_a_persons_words_are_not_common(spark):
    rows = [(f"Blue Harbor drops files{i}. Per Greta Lindqvist the rule stays{i}.",) for i in range(30)] + [("signed off by Greta Lindqvist",)]
    lexicon = pii.lexicon_of(spark.createDataFrame(rows, "t string"), "t")
    assert "blue harbor" in lexicon.pairs and {"greta", "lindqvist"} <= lexicon.words and "greta lindqvist" not in lexicon.pairs
    assert [k for _, _, k in pii.find("Spoke with Greta Lindqvist about it.", pii.Lexicon(lexicon.lower | {"spoke", "with"}, lexicon.words, lexicon.pairs))] == ["person_name"]


def test_other_scripts_and_what_is_no_name():
    empty = pii.Lexicon()
    for text, want in (
        ("12 Via Roma, 00184 Roma", "address"), ("ул. Ленина, 12", "address"), ("北京市朝阳区建国路88号", "address"), ("Spoke with Иван Петров about it.", "person_name"),
        ("联系人：王小明，电话。", "person_name"), ("王小明先生来了", "person_name"),
    ):
        assert [k for _, _, k in pii.find(text, empty)] == [want], text
    for text in ("My SSN is here", "P.O. Box 12", "Unter den Linden is a street", "高兴 的 日子 方法"):
        assert pii.find(text, empty) == [], text


def test_messages_are_exact_on_chains_and_rest_in_loops():
    import itertools

    import numpy as np

    model, k = pii.trained(), len(pii.LABELS)
    text = "SSN 951-76-1071 and +1 (555) 010-2233, row 474-56-678. Spoke with Greta Lindqvist."
    segs = pii.segments(text, _lexicon())
    assert 3 <= len(segs) <= 5 and all(kind == "chain" for _, _, kind in pii.edges(segs))
    unary = [sum((model.weights[model.index[f]] for f in s.features if f in model.index), np.zeros(k)) for s in segs]
    total = np.zeros((len(segs), k))
    for labels in itertools.product(range(k), repeat=len(segs)):
        score = sum(u[a] for u, a in zip(unary, labels)) + sum(model.pair[kind][labels[i], labels[j]] for i, j, kind in pii.edges(segs))
        for i, a in enumerate(labels):
            total[i, a] += np.exp(score)
    assert model.label(segs) == total.argmax(axis=1).tolist()
    # The cue stands at the last of many mentions; all of them follow it, however far away.
    repeated = "951-76-1071 again.\n" * 40 + "SSN 951-76-1071 is on file.\n"
    assert set(model.label(pii.segments(repeated, _lexicon()))) == {pii.LABELS.index("id_number")}
    many = [pii.segments(t, _lexicon()) for t, _ in TEXTS]
    assert model.label_all(many) == [model.label(s) for s in many]


def test_time_follows_the_length():
    import time

    def seconds(n):
        text = "".join(f"Call +1 (555) {i % 900 + 100}-{i % 9000 + 1000} if it stays down.\n" for i in range(n))
        start = time.process_time()
        assert len(pii.find(text, _lexicon())) >= n
        return time.process_time() - start

    seconds(200)
    assert seconds(6000) < 12 * max(seconds(1500), 0.05)


def test_the_lexicon_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(pii, "LEXICON", 10)
    df = spark.createDataFrame([(" ".join(f"word{chr(97 + i)}" for i in range(26)),)] * 5 + [("worda only",)] * 40, "t string")
    assert pii.lexicon_of(df, "t").lower == {"worda", "only"}
