import random

from quillmesh.llm.leakage import align_all, alignments, leaks, repeated_items, words

ITEM = "The amber charter of Calfatam lets every night-porter translate 8560 seals per psalter unless one painted belfry stands empty at dawn"


def test_words_ignore_what_does_not_count():
    w = words("The **amber** charter, of <b>Calfatam</b>!")
    assert w == ["the", "amber", "charter", "of", "calfatam"]
    assert words("night-\nporter [text](https://x.example) [[a|b c]] \\emph{d} caf\u00e9 ﬁve") == ["nightporter", "text", "b", "c", "d", "café", "five"]
    assert words("") == []
    assert words("これはThe 記録 café") == [*"これは", "the", *"記録", "café"]


def test_alignment_against_a_model():
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    for (a, b), (score, _, run) in zip(pairs, align_all(pairs, cells=40)):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        best = longest = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
                n = 0
                while n < min(i, j) and a[i - 1 - n] == b[j - 1 - n]:
                    n += 1
                longest = max(longest, n)
        assert (score, run) == (best, longest)


def test_found_pairs(spark):
    w = ITEM.split()
    rows = [(1, "Intro. " + ITEM + " End."), (2, "x " + " ".join(w[3:15]) + " y"), (3, "x " + " ".join(w[3:14]) + " y"), (4, ITEM.upper().replace(" ", "\n> ")), (5, " ".join(x if i % 4 else "other" for i, x in enumerate(w))), (6, None), (7, ""), (8, "nothing here"), (9, ITEM.replace("amber", "**amber**").replace("night-porter", "night-\nporter")), (1, "Intro. " + ITEM + " End.")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, seeds string")
    items = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, "too short")], "item_id long, text string")
    for limit in (1_000_000, 0):  # 0: the shuffle join instead of the broadcast
        scored = alignments(docs, "doc_id", "text", items, "item_id", "text", broadcast_seeds=limit).collect()
        assert len(scored) == len({(r["item_id"], r["doc_id"]) for r in scored})
        found = {(r["item_id"], r["doc_id"]) for r in scored if r["longest_run"] >= 12}
        assert found == {(i, d) for i in (1, 2) for d in (1, 2, 4, 9)}
        assert all(r["rarest_df"] >= 1 and r["matched"] <= len(w) for r in scored)
    assert {tuple(r) for r in repeated_items(docs, "doc_id", "text", items, "item_id", "text").collect()} == found
    assert repeated_items(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert repeated_items(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_only_rare_seeds_join_and_none_of_a_run_is_lost(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6)]
    phrase = "the usual words that all of them have in common here".split()
    items = [[rng.choice(vocabulary) for _ in range(8)] + phrase + [rng.choice(vocabulary) for _ in range(14)] for _ in range(6)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 20))] + phrase + [rng.choice(vocabulary) for _ in range(10)] for _ in range(30)]
    for k in range(12):
        at = rng.randint(0, 10)
        texts[k][5:5] = items[k % 6][at : at + rng.randint(9, 16)]
    texts.append("一二三四五六七八九十百千万".split()[0])
    items.append(list("三四五六七八九十百千万一二"))
    texts = [" ".join(t) if isinstance(t, list) else t for t in texts]
    texts += [texts[0]] * 3  # copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")

    def runs(n):
        grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
        return {(i, d) for i, a in enumerate(items) for d, b in enumerate(texts) if grams(" ".join(a)) & grams(b)}

    for limit in (1_000_000, 0):
        pairs = alignments(docs, "doc_id", "text", held, "item_id", "text", broadcast_seeds=limit).collect()
        got = {(r["item_id"], r["doc_id"]): r["longest_run"] for r in pairs}
        assert runs(8) <= set(got) and all(n >= 5 for n in got.values())
        assert {k for k, n in got.items() if n >= 12} == runs(12)
    # A phrase of five words that every document holds brings no pair about.
    other = docs.limit(0).union(spark.createDataFrame([(i, f"a{i} b{i} the usual words that all c{i}") for i in range(40)], "doc_id long, text string"))
    assert alignments(other.union(docs), "doc_id", "text", held, "item_id", "text").where("doc_id < 40 AND longest_run < 6").count() < 40


def test_edited_copies_have_a_kind(spark):
    w = ITEM.split()
    edited = " ".join("changed" if i in (8, 17) else x for i, x in enumerate(w))
    docs = spark.createDataFrame([(1, "before it " + edited + " after it"), (2, ITEM), (3, " ".join(w[:7]) + " goes on in another way")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {(r["doc_id"], r["kind"]) for r in leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(1, "edited"), (2, "repeat")}
