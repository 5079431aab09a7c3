import pytest

from quillmesh.llm.encoding_repair import repair, repaired

CLEAN = [
    "Le relais complète la tâche différée grâce au contrôle.", "Die Brücke öffnet den größten Abschnitt gemäß der Übersicht.", "A AÇÃO PADRÃO não apaga SEM EXCEÇÃO.", "¿por qué no? años páginas", "Обзор удаляет старые записи после проверки.", "ВНИМАНИЕ ВСЕМ", "検索結果は古い項目を毎晩保存します。", "调度器检查过长的片段每次审查之后。",
    "├── writer\n│   └── split.md", "±3 °C § 4 — “quoted” … 40 € café–style naïve team’s", "plain ascii", "", "пёс и ёж", "Ελληνικά",
]
TEXTS = CLEAN[:5] + CLEAN[6:8] + [CLEAN[9]]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert repair(text) == (text, 0, False)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251", "koi8-r"])
def test_round_trips(read):
    for text in TEXTS:
        try:
            garbled = text.encode("utf-8").decode(read)
        except UnicodeError:
            continue
        fixed, layers, lost = repair(f"Before it. {garbled} After.")
        assert layers >= 1, (read, text)
        assert fixed == f"Before it. {text} After.", (read, text, garbled)


def test_nested_layers():
    text = "naïve café – “session”"
    twice = text.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert repair(twice)[:2] == (text, 2)


@pytest.mark.parametrize("meant,read", [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp932", "cp1252")])
def test_other_pairs(meant, read):
    text = CLEAN[6] if meant == "cp932" else CLEAN[4]
    raw = text.encode(meant)
    garbled = "".join(bytes([b]).decode(read) if read != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    assert repair(f"user: {garbled}")[0] == f"user: {text}"


def test_lost_characters_count():
    assert repair("cr\ufffdneau")[2]
    garbled = CLEAN[7].encode("utf-8").decode("gb18030", "replace")
    _, layers, lost = repair(garbled)
    assert layers or lost


def test_tables(spark):
    rows = [(1, CLEAN[0]), (2, CLEAN[0].encode().decode("latin-1")), (3, None), (4, ""), (5, "ascii"), (6, "40 â\x82¬"), (2, CLEAN[0].encode().decode("latin-1"))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, layers string")
    got = {r["doc_id"]: r["text"] for r in repaired(df, "doc_id", "text").collect()}
    assert got == {2: CLEAN[0], 6: "40 €"}
    assert repaired(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("meant,word", [("gb18030", "你好"), ("gb18030", "请保存"), ("cp932", "テスト"), ("cp932", "検索結果")])
def test_short_double_byte_words_in_ascii_lines(meant, word):
    garbled = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in word.encode(meant))
    line = "The note says {} in an otherwise plain English line, and then goes on."
    assert repair(line.format(garbled)) == (line.format(word), 1, False)


@pytest.mark.parametrize("text", ["Größe, Ä, Ö and ÄÖ are kept as they are in this line.", "Les «Été» et référé, dépêché in a long plain line.", "not SEM EXCEÇÃO, ações e opções in plain text", "±3 °C § 4 — “quoted” … 40 € ‚so‘ and ‚so‘ in a long plain line"])
def test_accents_in_ascii_lines_stay(text):
    assert repair(text) == (text, 0, False)


def test_layers_have_no_bound():
    for want in ("Über die Brücke führt ein schöner Weg", "Déjà vu à l’été"):
        text = want
        for n in range(1, 9):
            text = text.encode("utf-8").decode("latin-1")
            assert repair(text)[:2] == (want, n)
