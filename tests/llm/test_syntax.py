import ast
import json
import random
import tomllib

import pytest

from quillmesh.llm.syntax import invalid, rates
from quillmesh.llm.syntax_lexers import verdict

GOOD = {
    "py": ['def f(a, *, b=1):\n    """Doc (."""\n    try:\n        return {k: v for k, v in a.items() if not v}\n    except (ValueError, OSError) as e:\n        raise X(f"{e}") from e\n    finally:\n        pass\n\n\n@dec(1)\nclass A(B):\n    x: int = 3\n\n    async def g(self) -> list[int]:\n        async with self as s:\n            return [*s, -1, not s][::2]\n', "# <<<<<<< HEAD\nx = '''\n<<<<<<< HEAD\n'''\n", "x = lambda a, b=2: a if b else (yield)\nif x: pass\nelse: pass\nmatch x:\n    case 1:\n        pass\n", ""],
    "js": ["const a = (x) => { return x / 2 / 3; };\nconst r = /[/(]+/g.test(`${a(1)} ( ${`in ${1}`}`);\nclass A extends B { static x() { return this.y?.z ?? 1; } }\nfor (const [k, v] of Object.entries(o)) { if (k) continue; }\nlabel: while (1) { break label; }\n", "const t = `\n<<<<<<< HEAD\n`;\n", "try { f(); } catch { g(); } finally { h(); }\nexports.default = { default: 1, class: 2, 'a-b': [3,], };\n"],
    "java": ['package a.b;\nimport java.util.*;\npublic class A<T extends B> {\n    private final List<String> x = new ArrayList<>();\n    @Override\n    public int f(String... a) { for (String s : a) { if (s.equals("{") && x.size() > 1) { return 1; } } return \'}\'; }\n}\n', "enum E { A, B; boolean f() { return this != A; } }\n"],
    "c": ['#include <stdio.h>\n#define X(a) ((a) * \\\n 2)\nstatic const char *f(int w)\n{\n    switch (w) {\n    case 0:\n        return "a {" "b";\n    default:\n        return 0;\n    }\n}\nstruct s { int a; double b; };\nint t[] = { 1, 2, };\n', "#if A\nint x;\n#else\nint y;\n#endif\n"],
    "sh": ['#!/bin/sh\nset -eu\nf() {\n  local a="$1"\n  if [ -z "$a" ]; then\n    echo "x $(date +%s) ${a:-"y"}" >&2\n  fi\n}\nfor i in a b; do\n  case "$i" in\n    a|b) echo done ;;\n    *) echo "fi" ;;\n  esac\ndone\ncat <<EOF\nif (\nEOF\n', "a=(1 2)\necho $((1 + 2)) # it's\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}', "[]", '"x"'],
    "toml": ['a = 1\n[x."y z"]\nb = [1, 2,\n 3]\nc = { d = "e", f = 2026-02-03 }\ns = """\n[not]\n"""\n[[arr]]\n'],
    "yaml": ["a:\n  b: 1\n  c:\n    - x\n    - y: z\n      w: v\nd: |\n  <<<<<<< text\n  k: v: w\ne: \"q: r\"\nf: [1, {g: h}]\n"],
}
BAD = {
    "py": ["def f(:\n    pass\n", "x = (1\n", "x = 'a\n", "def f():\nreturn 1\n", "import os\n<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "function f(a) {\n}\n", "try:\n    x\n", "if x\n    y\n", "x = = 1\n"],
    "js": ["function f( {\n}\n", "const x = ;\n", "import os\n", "let a = 'x\n';", "if x { }\n", "const a = `x", "def f(a):\n    return a\n"],
    "java": ["class A { int f() { return 1; }\n", "class A { int f() { return 1 } }\n", "x = 1\n", "class A { String s = \"x; }\n"],
    "c": ["int f( {\n}\n", "import os\n\ndef f(a):\n    return a\n", "int f() { return 1; \n", "{\"a\": 1}\n"],
    "sh": ["if true; then\n echo\n", "for i in a; do\n echo $i\n", "echo 'x\n", "def f(a):\n", "case x in\n a) echo ;;\n\ncase y in\n b) echo ;;\nesac\n"],
    "json": ['{"a": 1,}', "{'a': 1}", '{"a": 01}', '{"a"', '{"a": 1} x', "", "NaN"][:5] + ["NaN"],
    "toml": ["a b = 1\n", "[x\n", "a = [1, 2\n", 'a = "x\n', "a = 1 2\n"],
    "yaml": ["a:\n  b: 1\n<<<<<<< ours\n  c: 2\n", "a: b\n  c: d\n", 'a: "x\n', "a: [1, 2\n"],
}


MORE_GOOD = {
    "py": ["x: Foo() = 3\n", "f().x = f()[0] = 1\n", "x = 'a' == y\n", "f(a=1)\n"], "java": ["class A { Class<?> c = A.class; int x = 1; record B(int a) {} }\n"], "js": ["o.return = 3; const { a = 1 } = { return: 2 };\n"],
    "c": ["int (*f)(void) = 0;\n"], "yml": ["a: 1\n"], "ts": ["const f = <T>(a: T[]): Map<string, T> => { return /[(]/.test(`${a}`) ? x : y; };\n"], "go": ["package a\nfunc f() string { return `{` + \"}\" + string('{') }\n"],
    "rs": ["fn f<'a>(x: &'a str) -> char { let s = r#\"{\"\"#; '}' }\n"], "cpp": ["auto s = R\"x({)\"})x\"; char c = '{';\n"], "cs": ["var s = @\"{\"\"\"; // }\n"], "rb": ["x = %q{(}\n"], "h": ["/* { */\n#define A \"(\"\n"],
}
MORE_BAD = {
    "py": ["return = 3\n", "1 = x\n", "f() = 3\n", "x = None = 2\n", "try:\n    x\nexcept E as e:\n    raise V(e) from\n"], "java": ["public void class X {}\n", "class A { int = 3; }\n", "class { }\n"], "js": ["return = 3;\n", "if = 2;\n"], "c": ["int = 3;\n", "struct int x;\n"], "yml": ["a: [1\n"],
    "ts": ["function f(a: number {\n}\n"], "go": ["func f() {\n", "x := `a\n"], "rs": ["fn f() { (] }\n"], "cpp": ["int x; /* a\n"], "rb": ["<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n"], "h": ["<<<<<<< ours\nint x;\n"],
}


def test_more_grammar_and_more_languages():
    for cases, valid in ((MORE_GOOD, True), (MORE_BAD, False)):
        for lang, texts in cases.items():
            for t in texts:
                assert (verdict(lang, t) is None) == valid, (lang, t, verdict(lang, t))
    assert verdict("js", "`${" * 5000) and verdict("md", "<<<<<<< x") is None


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_lexers(lang):
    for t in GOOD[lang]:
        assert verdict(lang, t) is None, t
        assert verdict(lang, t.replace("\n", "\r\n")) is None, t
    for t in BAD[lang]:
        assert verdict(lang, t), t


def _parses(lang, text):
    try:
        {"py": ast.parse, "json": lambda t: json.loads(t, parse_constant=lambda c: 1 / 0), "toml": tomllib.loads}[lang](text)
        return True
    except Exception:
        return False


@pytest.mark.parametrize("lang", ["py", "json", "toml"])
def test_damaged_files_are_flagged_as_parsers_flag_them(lang):
    rng, agree, n = random.Random(5), 0, 0
    for _ in range(400):
        text = rng.choice([t for t in GOOD[lang] if t])
        at = rng.randrange(len(text))
        damaged = text[:at] if rng.random() < 0.5 else text[:at] + text[at + 1 :]
        if not damaged:
            continue
        n += 1
        agree += (verdict(lang, damaged) is None) == _parses(lang, damaged)
    assert agree >= 0.93 * n


def test_tables(spark):
    rows = [(1, "r", "a.py", "x = 1\n"), (2, "r", "./b.py", "x = (\n"), (3, "r", "b.py", "x = (\n"), (4, "s", "c.txt", "x = ("), (5, "s", None, "("), (6, "s", "d.js", None), (7, "s", "e.json", ""), (8, "s", "f.JSON", "{")]
    df = spark.createDataFrame(rows, "record_id long, repository string, path string, text string").selectExpr("*", "'clash' AS reason", "'x' AS lang")
    assert {r["record_id"] for r in invalid(df, "record_id", "path", "text").collect()} == {2, 3, 8}
    got = {(r["repository"], r["lang"]): (r["files"], r["invalid"], r["rate"]) for r in rates(df, "record_id", "repository", "path", "text").collect()}
    assert got == {("r", "py"): (2, 1, 0.5), ("s", "json"): (1, 1, 1.0)}
    assert invalid(df.limit(0), "record_id", "path", "text").count() == 0
