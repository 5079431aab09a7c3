import numpy as np

from quillmesh.llm import markup

CASES = [
    ("# Title\n\n- one\n- two\n\n```py\nx = a[1] < 2 # [[no]]\n```\n", ["markdown"]),
    ("See [[Page|text]] and '''bold'''.\n\n== Head ==\n", ["wiki"]),
    ("- supplies [[Page]] (x)", ["markdown", "wiki"]),
    ("\\section{A} The bound \\( x \\le 4 \\) holds~\\cite{b}.", ["latex"]),
    ("<p>One<br/>two &amp; three</p>", ["html"]),
    ("a &nbsp; b", ["html"]),
    ("It costs $40 today and $55 next year. If a < 0 and b > 2. AT&T, C# and 4 * 3 * 2, path C:\\temp\\intent, snake_case_name, #711", []),
    ("Title\n=====\ntext ~~old~~ **new**", ["markdown"]),
    ("A [link](https://x.example/a) | x\n|---|---|\n| 1 | 2 |", ["markdown"]),
    ("`code with <b> and [[x]]`", ["markdown"]),
    ("-----BEGIN PRIVATE KEY-----\nab*cd*\n-----END PRIVATE KEY-----", []),
    ("$w_i = \\frac{1}{k}$", ["latex"]),
    ("{{note|x}} text {| class=\"w\"\n|-\n! a\n|-\n| b || c\n|}", ["wiki"]),
]


def test_kinds():
    for body, want in CASES:
        assert markup.convert(body)[0] == want, body


def test_structure_stays():
    assert markup.convert("<h2>Head</h2><ul><li>one</li><li>two</li></ul><pre><code>x &lt; 1</code></pre>")[1].split("\n") == ["## Head", "", "- one", "- two", "", "```", "x < 1", "```"]
    assert markup.convert("\\begin{itemize}\n\\item A\n\\item B\n\\end{itemize}")[1] == "- A\n- B"
    assert markup.convert("<table><tr><td>a</td><td>b</td></tr></table>")[1] == "| a | b |"
    assert markup.convert("== H ==\ntext [[a|b]]")[1] == "## H\ntext b"
    assert "$x^2$" in markup.convert("so $x^2$ holds")[1]
    plain = "Nothing here. Two lines\nand no markup."
    assert markup.convert(plain) == ([], plain)


def test_repeats_against_brute_force():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 4, rng.integers(0, 40)).tolist() for _ in range(12)]
    pages = [int(p) for p in rng.integers(0, 6, 12)]
    got = markup.repeated_windows(markup.Streams([" ".join(map(str, x)) for x in streams]), np.array(pages), 5)
    for s, p, g in zip(streams, pages, got):
        want = [i for i in range(len(s) - 4) if any(q < p and t[j : j + 5] == s[i : i + 5] for t, q in zip(streams, pages) for j in range(len(t) - 4))]
        assert g.tolist() == want
    assert markup.repeated_windows(markup.Streams(["", ""]), np.array([1, 2]), 5)[0].tolist() == []


def test_fingerprints_are_shared_by_equal_stretches():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 99, 9)
    a, b = np.concatenate((rng.integers(0, 99, 30), shared)), np.concatenate((rng.integers(0, 99, 17), shared, rng.integers(0, 99, 40)))
    assert {int(i) - 30 for i in markup.fingerprints(a, 9)} & {int(i) - 17 for i in markup.fingerprints(b, 9)} & set(range(9))
    assert markup.fingerprints(np.array([3, 1, 2]), 9).tolist() == [1] and not len(markup.fingerprints(np.zeros(0), 4))


def test_depth_has_no_bound():
    body = "\\textbf{" * 9 + "deep" + "}" * 9 + " and ${" + "x+" * 300 + "y}$"
    kinds, text = markup.convert(body)
    assert kinds == ["latex"] and text.startswith("deep and $") and "textbf" not in text
    nested = "{{a|" * 6 + "x" + "}}" * 6 + " rest"
    assert markup.convert(nested) == (["wiki"], "rest")
    code = "<pre>" + "".join(f"<code>a{i}</code> `b` $x_{i}$ " for i in range(5)) + "</pre>"
    assert "\ue000" not in markup.convert(code)[1]


def test_a_page_with_most_rows_is_dealt_to_all_blocks(spark):
    boiler = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "host/hot.md" if i % 3 else f"host/p{i}.md", f"own{i} {boiler} tail{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "note_id long, path string, body string")
    one, many = ({r["note_id"]: r["text"] for r in markup.clean(df, "note_id", "path", "body", block_chars=c).collect()} for c in (4_000_000, 900))
    assert one == many and len({p for (i, p, _) in rows if boiler in one[i]}) == 1


def test_boilerplate_goes_in_blocks_and_across(spark):
    boiler = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"host/p{i}.md", f"start unique{i}\n\n{boiler}\n\nunique{i}b end") for i in range(12)]
    rows += [(100, "host/p0.md", rows[0][2]), (101, "other/q.md", "short"), (102, None, boiler), (103, "host/x.md", None), (104, "host/y.md", "")]
    df = spark.createDataFrame(rows, "note_id long, path string, body string").selectExpr("*", "'clash' AS kinds", "1 AS _block")
    for chars in (4_000_000, 1_000):
        got = {r["note_id"]: r["text"] for r in markup.clean(df, "note_id", "path", "body", block_chars=chars).collect()}
        assert set(got) == {*range(12), 100, 101, 102}
        assert all(f"start unique{i}\n" in got[i] and f"unique{i}b end" in got[i] for i in range(12))
        assert got[100] == got[0] and boiler in got[102]
        kept = [i for i in range(12) if "word20" in got[i]]
        assert len(kept) == 1
    assert markup.clean(df.limit(0), "note_id", "path", "body").count() == 0


def test_result_does_not_depend_on_the_size_of_blocks(spark):
    rng = np.random.default_rng(11)
    parts = [" ".join(f"part{k}x{i}" for i in range(n)) for k, n in enumerate([*range(16, 31), 60])]
    rows = []
    for i in range(60):
        body = []
        for j, k in enumerate(rng.choice(len(parts), 4, replace=False)):
            body += [f"own{i}n{j}", parts[k]]
        rows.append((i, f"host/p{i}.md", " ".join(body) + f" own{i}end"))
    rows += [(100, "host/p0.md", rows[0][2]), (101, "host/long.md", parts[-1] + " tail"), (102, "host/cut.md", " ".join(parts[-1].split()[10:50]))]
    df = spark.createDataFrame(rows, "note_id long, path string, body string")
    whole, blocks = ({r["note_id"]: r["text"] for r in markup.clean(df, "note_id", "path", "body", block_chars=c).collect()} for c in (4_000_000, 1_500))
    assert blocks == whole
    for k, n in enumerate(range(16, 31)):
        held, left = sum(parts[k] in body for _, _, body in rows), sum(parts[k] in t for t in blocks.values())
        assert left == held if n < 24 else left <= 2 and not any(f"part{k}x" in t for t in blocks.values() if parts[k] not in t)
