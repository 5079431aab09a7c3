import random
from collections import Counter

from quillmesh.llm.packing import _encoder, pack, pack_histogram


def test_histogram_packing_places_everything():
    rng = random.Random(2)
    for capacity in (10, 100, 8192):
        h = Counter(min(capacity, int(rng.lognormvariate(3, 1.3)) + 1) for _ in range(3000))
        patterns = pack_histogram(h, capacity)
        placed: Counter = Counter()
        for pattern, n in patterns:
            assert sum(l * k for l, k in pattern) <= capacity and n > 0
            for length, times in pattern:
                placed[length] += times * n
        assert placed == h
        containers = sum(n for _, n in patterns)
        assert sum(l * n for l, n in h.items()) >= 0.9 * (containers - 1) * capacity
    assert pack_histogram({}, 10) == []


def test_no_item_is_split_unless_it_exceeds(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["ledger", "note", "ünïcode", "日本語"]) for _ in range(rng.randint(1, 60))), "x") for i in range(150)]
    rows += [(200, "word " * 900, "x"), (201, None, "x"), (202, "", "x"), (203, rows[0][1], "x"), *((300 + i, "same text", "x") for i in range(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    for per_bucket in (50_000, 7):  # with 7 a hot length is spread over buckets
        got = pack(df, "doc_id", "text", capacity=256, rows_per_bucket=per_bucket).collect()
        encode = _encoder("byte_bpe_50k.tiktoken").encode_ordinary
        size = {i: len(encode(t)) for i, t, _ in rows if t}
        held: Counter = Counter()
        parts: Counter = Counter()
        for r in got:
            held[r["container"]] += r["tokens"]
            parts[r["doc_id"]] += r["tokens"]
        assert parts == Counter(size) and max(held.values()) <= 256
        assert {r["doc_id"] for r in got if r["piece"] > 0} == {200}
        assert len({(r["container"], r["slot"]) for r in got}) == len(got)
        assert sorted(held) == list(range(len(held)))
        assert sum(held.values()) >= 0.95 * 256 * (len(held) - 1)
    assert pack(df.limit(0), "doc_id", "text").count() == 0
