"""Structural facts of source files: nodes and links per file, by a registry of language passes."""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import spread

#: (label, kind, line, body, parent label or "")
Node = tuple[str, str, int, str, str]
#: (source label or "", target label, relation)
Link = tuple[str, str, str]
MAX_NODES, BODY, MAX_CHARS, MIN_NAME = 200, 200, 400 * 1024, 2
# Files that no pass reads.
LOCK_FILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "cargo.lock", "composer.lock", "gemfile.lock", "uv.lock")
REGISTRY: dict[str, Callable[[str], tuple[list[Node], list[Link]]]] = {}


def language(*extensions: str):
    def register(f):
        for e in extensions:
            REGISTRY[e] = f
        return f

    return register


@language("py")
def python(text: str) -> tuple[list[Node], list[Link]]:
    """Functions, classes and methods with the first paragraph of their docstrings or the comment above them; imports,
    calls and base classes; what a definition calls that the file itself defines is linked by its full label."""
    tree = ast.parse(text)
    nodes: list[Node] = []
    links: list[Link] = []
    lines = text.split("\n")

    def first(n: ast.AST) -> str:
        doc = ast.get_docstring(n) if isinstance(n, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else ""
        if not doc:
            at = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 2
            above = []
            while at >= 0 and lines[at].strip().startswith("#"):
                above.insert(0, lines[at].strip().lstrip("# "))
                at -= 1
            doc = "\n".join(above)
        return " ".join(doc.split("\n\n")[0].split())[:BODY]

    def scope(body: list[ast.stmt], parent: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                label = f"{parent}.{n.name}" if parent else n.name
                nodes.append((label, "method" if parent else "function", n.lineno, first(n), parent))
                links.extend((label, c, "calls") for c in sorted({x.func.id if isinstance(x.func, ast.Name) else x.func.attr for x in ast.walk(n) if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute))}))
            elif isinstance(n, ast.ClassDef):
                label = f"{parent}.{n.name}" if parent else n.name
                nodes.append((label, "class", n.lineno, first(n), parent))
                links.extend((label, ast.unparse(b), "inherits") for b in n.bases if isinstance(b, (ast.Name, ast.Attribute)))
                scope(n.body, label)
            elif isinstance(n, ast.Import):
                links.extend(("", a.name, "imports") for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                links.append(("", "." * n.level + (n.module or ""), "imports"))

    scope(tree.body, "")
    # A called name that one definition here bears is that definition, the caller's own class first.
    bearers: dict[str, list[str]] = {}
    for label, *_ in nodes:
        bearers.setdefault(label.rsplit(".", 1)[-1], []).append(label)

    def resolved(source: str, name: str) -> str:
        known = bearers.get(name.rsplit(".", 1)[-1], [])
        own = [k for k in known if "." in source and k.rsplit(".", 1)[0] == source.rsplit(".", 1)[0]]
        return own[0] if len(own) == 1 else known[0] if len(known) == 1 else name

    return nodes, [(s, resolved(s, t) if r in ("calls", "inherits") else t, r) for s, t, r in links]


@language("json")
def json_keys(text: str) -> tuple[list[Node], list[Link]]:
    """Keys of a top-level object by dotted label; scalars as bodies."""
    return _tree(json.loads(text))


@language("toml")
def toml_keys(text: str) -> tuple[list[Node], list[Link]]:
    return _tree(tomllib.loads(text), "table")


def _tree(value: object, inner: str = "key") -> tuple[list[Node], list[Link]]:
    nodes: list[Node] = []

    def walk(obj: dict, parent: str, depth: int) -> None:
        for k, v in obj.items():
            label = f"{parent}.{k}" if parent else str(k)
            if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                nodes.append((label, inner, 0, f"{len(v)} entries", parent))
                for n, x in enumerate(v):
                    nodes.append((f"{label}[{n}]", inner, 0, " · ".join(f"{a}: {b}" for a, b in x.items() if not isinstance(b, (dict, list)))[:BODY], label))
                    if depth < 64:
                        walk(x, f"{label}[{n}]", depth + 1)
            elif isinstance(v, dict):
                body = " · ".join(f"{a}: {b}" for a, b in v.items() if not isinstance(b, (dict, list)))[:BODY]
                nodes.append((label, inner, 0, body, parent))
                if depth < 64:
                    walk(v, label, depth + 1)
            else:
                nodes.append((label, "key", 0, str(v)[:BODY], parent))

    if isinstance(value, dict):
        walk(value, "", 0)
    return nodes, []


@language("yaml", "yml")
def yaml_keys(text: str) -> tuple[list[Node], list[Link]]:
    """Keys by indentation; lists and block texts are bodies of their key."""
    nodes: list[Node] = []
    stack: list[tuple[int, str]] = []
    block: int | None = None
    for n, line in enumerate(text.split("\n"), 1):
        if block is not None and (not line.strip() or len(line) - len(line.lstrip()) > block):
            continue  # the text of a block scalar holds no keys
        block = None
        m = re.match(r"( *(?:- +)*)([\w./-]+|\"[^\"]*\"|'[^']*'):(?:\s+(.*))?$", line)
        if not m:
            continue
        width, key = len(m[1]), m[2].strip("\"'")
        if re.match(r"[|>][+-]?\d?\s*(?:#.*)?$", m[3] or ""):
            block = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= width:
            stack.pop()
        parent = stack[-1][1] if stack else ""
        label = f"{parent}.{key}" if parent else key
        nodes.append((label, "key", n, (m[3] or "")[:BODY], parent))
        stack.append((width, label))
    return nodes, []


@language("md", "markdown")
def markdown(text: str) -> tuple[list[Node], list[Link]]:
    """Headings nested by level, each with its own prose; links as references."""
    nodes: list[Node] = []
    links: list[Link] = []
    stack: list[tuple[int, str]] = []
    body: list[str] = []
    clean = re.sub(r"(?ms)^(```|~~~).*?^\1[ \t]*$", lambda m: "\n" * m.group().count("\n"), text)
    # Underlined headings take the form of the others, on the same line.
    clean = re.sub(r"(?m)^(?![ \t]*[-*+>|#])[ \t]*(\S[^\n]*)\n[ ]{0,3}(=+|-{2,})[ \t]*$", lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1]}\n", clean)

    def close() -> None:
        if nodes:
            label, kind, line, _, parent = nodes[-1]
            nodes[-1] = (label, kind, line, " ".join(" ".join(body).split())[:BODY], parent)
        body.clear()

    for n, line in enumerate(clean.split("\n"), 1):
        m = re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            close()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            nodes.append((m[2], "heading", n, "", stack[-1][1] if stack else ""))
            stack.append((len(m[1]), m[2]))
        else:
            body.append(line)
            links.extend((stack[-1][1], t.split("|")[0].strip(), "references") for t in re.findall(r"\[\[([^\[\]]+)\]\]", line) if stack)
            links.extend((stack[-1][1], t.strip("<>").split("#")[0], "references") for t in re.findall(r"(?<!!)\[[^\[\]]*\]\(\s*(<[^<>]*>|[^()\s]+)[^()]*\)", line) if stack and not re.match(r"[a-zA-Z][\w+.-]*:|#", t.strip("<>")))
    close()
    return nodes, links


@language("rst")
def restructured(text: str) -> tuple[list[Node], list[Link]]:
    """Sections by the order in which their adornments first appear."""
    order: list[str] = []
    nodes: list[Node] = []
    stack: list[tuple[int, str]] = []
    lines = text.split("\n")
    for n in range(1, len(lines)):
        a = lines[n].strip()
        if len(a) >= 3 and re.fullmatch(r"([=\-~^\"'`#*+:.])\1+", a) and lines[n - 1].strip() and len(a) >= len(lines[n - 1].strip()):
            if a[0] not in order:
                order.append(a[0])
            level = order.index(a[0])
            while stack and stack[-1][0] >= level:
                stack.pop()
            nodes.append((lines[n - 1].strip(), "heading", n, "", stack[-1][1] if stack else ""))
            stack.append((level, lines[n - 1].strip()))
    # A section's body is its prose up to the next one, roles and adornments taken off.
    starts = [n for _, _, n, _, _ in nodes] + [len(lines) + 1]
    plain = lambda t: " ".join(re.sub(r":[\w:+-]+:`([^`<]*?)(?:\s*<[^`]*>)?`|``([^`]*)``|`([^`<]*?)(?:\s*<[^`]*>)?`_*", lambda m: m[1] or m[2] or m[3] or "", t).split())
    nodes = [(label, kind, n, plain(" ".join(x for x in lines[n + 1 : starts[i + 1] - 1] if not re.fullmatch(r"\s*([=\-~^\"'`#*+:.])\1+\s*|\s*\.\. .*", x)))[:BODY], parent) for i, (label, kind, n, _, parent) in enumerate(nodes)]
    return nodes, [("", t.split("<")[-1].rstrip(">"), "references") for t in re.findall(r":(?:doc|ref):`([^`]+)`", text)]


@language("sql")
def sql(text: str) -> tuple[list[Node], list[Link]]:
    """Tables and columns of CREATE TABLE, and what they reference."""
    nodes: list[Node] = []
    links: list[Link] = []
    text = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    for m in re.finditer(r"(?i)create\s+(?:or\s+replace\s+)?(?:(?:global|local)\s+)?(?:(?:temp|temporary|unlogged|external|materialized|recursive|unique)\s+)*(view|index|function|procedure|trigger|type|sequence|schema)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)", text):
        nodes.append((m[2], m[1].lower(), text.count("\n", 0, m.start()) + 1, "", ""))
        end = text.find(";", m.end())
        body = text[m.end() : end if end >= 0 else len(text)]
        links.extend((m[2], t, "references") for t in dict.fromkeys(re.findall(r"(?i)\b(?:from|join|on|into|update)\s+[\"`\[]?([\w.]+)", body)) if m[1].lower() != "function")
    for m in re.finditer(r"(?i)create\s+(?:or\s+replace\s+)?(?:(?:global|local)\s+)?(?:(?:temp|temporary|unlogged|external)\s+)*table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)[\"`\]]?\s*\(", text):
        table, depth, end = m[1], 1, m.end()
        while end < len(text) and depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        nodes.append((table, "table", text.count("\n", 0, m.start()) + 1, "", ""))
        for part in re.split(r",(?![^()]*\))", text[m.end() : end - 1]):
            c = re.match(r"\s*[\"`]?(\w+)[\"`]?\s+(\w+(?:\([^)]*\))?)", part)
            if c and c[1].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key", "index", "like", "exclude"):
                nodes.append((f"{table}.{c[1]}", "column", 0, c[2], table))
            links.extend((table, r, "references") for r in re.findall(r"(?i)references\s+[\"`]?([\w.]+)", part))
    return nodes, links


_KINDS = ("class", "interface", "enum", "record", "struct", "union", "trait", "impl", "type", "module")
_CONTROL = frozenset("if for while switch catch return sizeof typeof function new await do else elif case super this import require print defined throw".split())
# Comments and literals, in which nothing is declared or called.
_NO_CODE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_DECLARED = {
    "generic": re.compile(r"^[ \t]*(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|open|final|abstract|override|static|async|suspend|export|unsafe|sealed|data|case|partial|virtual|inline|local)\s+)*(?:(class|interface|enum|struct|trait|record|object|module|impl|type|protocol|extension)|func|fun|fn|def|function|sub|proc)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_$][\w$.:]*)", re.M),
    "js": re.compile(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:(function|class)\s*\*?\s*([A-Za-z_$][\w$]*)|(const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*=>)", re.M),
    "java": re.compile(r"^[ \t]*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(class|interface|enum|record)\s+(\w+)", re.M),
    "c": re.compile(r"^(?:static\s+|extern\s+|inline\s+|const\s+)*(?:(struct|enum|union)\s+(\w+)\s*\{|[A-Za-z_][\w\s*]*?[\s*](\w+)\s*\([^;{}]*\)\s*\{)", re.M),
    "sh": re.compile(r"^(?:function\s+)?([A-Za-z_]\w*)\s*\(\)\s*\{", re.M),
}


def _declared(lang: str) -> Callable[[str], tuple[list[Node], list[Link]]]:
    def run(text: str) -> tuple[list[Node], list[Link]]:
        nodes, spans, calls = [], [], []
        code = _NO_CODE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        for m in _DECLARED[lang].finditer(code):
            words = [g for g in m.groups() if g]
            kind = words[0] if len(words) > 1 and words[0] in _KINDS else "function"
            if len(words[-1]) < MIN_NAME or words[-1] in _CONTROL:
                continue
            at = code.count("\n", 0, m.start()) + 1
            parent = next((label for label, inner, end in reversed(spans) if inner in _KINDS and m.start() < end), "")
            label = f"{parent}.{words[-1]}" if parent else words[-1]
            comment = re.search(r"(?:^[ \t]*(?://|#|\*|/\*)[^\n]*\n)+[ \t]*\Z", text[max(0, m.start() - 2000) : m.start()], re.M)
            said = " ".join(re.sub(r"(?m)^[ \t]*(?://+|#+|/\*+|\*+/?)|\*/", " ", comment.group()).split())[:BODY] if comment else ""
            nodes.append((label, "method" if parent and kind == "function" else kind, at, said, parent))
            open_ = code.find("{", m.end() - 1)
            end, depth = open_ + 1, 1
            while open_ >= 0 and end < len(code) and depth:
                depth += (code[end] == "{") - (code[end] == "}")
                end += 1
            spans.append((label, kind, end if open_ >= 0 else m.end()))
            if kind == "function" and open_ >= 0:
                calls += [(label, c, "calls") for c in sorted(set(re.findall(r"\b([A-Za-z_$][\w$]*)\s*\(", code[open_:end])) - _CONTROL - {words[-1]})]
            base = re.match(r"[^{;\n]*?\b(?:extends|implements)\s+([\w$., ]+)", code[m.end() :])
            if base and kind in _KINDS:
                calls += [(label, b.strip(), "inherits") for b in re.split(r",|\bimplements\b|\bextends\b", base[1]) if b.strip()]
        found = re.findall(r"(?m)^\s*import\s+(?:[^'\"\n]*from\s*)?['\"]([^'\"]+)['\"]|require\(['\"]([^'\"]+)['\"]\)|^import\s+(?:static\s+)?([\w.]+)\s*;|^#include\s*[<\"]([^>\"]+)", text)
        exported = [("", e, "exports") for e in re.findall(r"(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s*\*?\s*([A-Za-z_$][\w$]*)", text)] if lang == "js" else []
        return nodes, [("", next(t for t in f if t), "imports") for f in found] + exported + calls

    return run


for _lang, _exts in (("generic", ("go", "rs", "kt", "kts", "swift", "scala", "rb", "php", "lua", "dart", "tcl", "ex", "exs", "jl", "groovy", "zig", "nim", "pl")), ("js", ("js", "jsx", "ts", "tsx", "mjs", "cjs", "vue")), ("java", ("java", "cs")), ("c", ("c", "h", "cc", "cpp", "hpp")), ("sh", ("sh", "bash"))):
    language(*_exts)(_declared(_lang))


def readable(path: Column, text: Column, max_chars: int | None = MAX_CHARS) -> Column:
    """Whether a file is looked at: no lock, map, minified or hidden file, no NUL in it, not too long (None: of any length)."""
    name = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    skipped = name.isin(*LOCK_FILES) | F.endswith(name, F.lit(".map")) | name.contains(".min.") | name.startswith(".")
    return ~skipped & (F.length(text) > 0) & ~text.contains("\x00") & (F.length(text) <= max_chars if max_chars else F.lit(True))


def facts(files: DataFrame, key: str, path: str, text: str, max_nodes: int | None = MAX_NODES, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """(key, part, n, label, kind, line, body, other): nodes (other is the parent) and links (other is the target).

    A file that its language's pass cannot read has none, nor has one that is not ``readable``; nothing of one file
    reaches another. The first ``max_nodes`` nodes of a file are kept with the links whose source is left (None: all).
    """
    kind = files.schema[key].dataType.simpleString()
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    rows = files.where(readable(F.col(path), F.col(text), max_chars)).select(F.col(key).alias("_k"), ext.alias("_e"), F.col(text).alias("_t")).where(F.col("_e").isin(*REGISTRY))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, e, t in zip(batch["_k"], batch["_e"], batch["_t"]):
                try:
                    nodes, links = REGISTRY[e](t.replace("\r\n", "\n"))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                kept = nodes[:max_nodes]
                labels = {n[0] for n in kept} | {""}
                out += [(k, "node", i, label, kind, line, body, parent) for i, (label, kind, line, body, parent) in enumerate(kept)]
                out += [(k, "link", i, source, relation, 0, "", target) for i, (source, target, relation) in enumerate(links) if source in labels]
            yield pd.DataFrame(out, columns=[key, "part", "n", "label", "kind", "line", "body", "other"])

    return spread(rows).mapInPandas(work, f"{key} {kind}, part string, n int, label string, kind string, line int, body string, other string")


def symbol_relations(facts_: DataFrame, key: str, definitions: int | None = 200, relations: int | None = 400) -> DataFrame:
    """(key, label, relation, target): what each definition of a file calls or inherits, labels as ``Outer::inner``; at most
    ``relations`` of a file, of its first ``definitions`` definitions (None: all)."""
    nodes = facts_.where("part = 'node'").select(key, "label", "n")
    links = facts_.where("part = 'link' AND kind IN ('calls', 'inherits') AND label <> ''").select(key, "label", F.col("kind").alias("relation"), F.col("other").alias("target"), F.col("n").alias("_at")).distinct()
    if definitions:
        nodes = nodes.where(F.col("n") < definitions)
    held = links.join(nodes.select(key, "label").distinct(), [key, "label"], "left_semi")
    if relations:
        held = held.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_at", "target"))).where(F.col("_r") <= relations)
    qualified = lambda c: F.replace(c, F.lit("."), F.lit("::"))
    return held.select(key, qualified("label").alias("label"), "relation", qualified("target").alias("target")).distinct()


def symbols(nodes: DataFrame, key: str) -> DataFrame:
    """(key, line, symbol): the most qualified label of each line."""
    order = Window.partitionBy(key, "line").orderBy(F.size(F.split("label", r"\.")).desc(), F.length("label").desc(), F.col("label").desc())
    return nodes.where("part = 'node' AND line > 0").withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, "line", F.col("label").alias("symbol"))
