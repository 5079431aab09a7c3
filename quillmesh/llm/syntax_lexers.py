"""Lexers with a pushdown stack for the languages of source files, one verdict each.

``verdict(lang, text)`` gives None for a text in which nothing is wrong, else a short reason: an unterminated
literal or comment, unbalanced delimiters, a premature end, a merge-conflict marker, or tokens that cannot
stand where they do. Each lexer first reduces literals and comments to one sign each, so that what they hold
cannot mislead, then classes the remaining tokens and runs the delimiters through a stack. Nothing else decides;
the tests compare the lexers with the exact parsers that the library has.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$", re.M)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_BRACKET = re.compile(r"[()\[\]{}]")


def _balance(code: str) -> str | None:
    """The pushdown stack over the delimiters of ``code``."""
    stack: list[str] = []
    for c in _BRACKET.findall(code):
        if c in "([{":
            stack.append(c)
        elif not stack or stack.pop() != _PAIRS[c]:
            return "unbalanced delimiter"
    return "premature end" if stack else None


class _Broken(Exception):
    pass


# --- languages in the manner of C ---------------------------------------------------------------------------

_C_TOKEN = re.compile(r"//[^\n]*|/\*|\"\"\"|\"|'")
_JS_TOKEN = re.compile(r"//[^\n]*|/\*|\"|'|`|/")
_DOUBLE = re.compile(r'"[^"\\\n]*(?:\\(?:\n|.)[^"\\\n]*)*"')
_SINGLE = re.compile(r"'[^'\\\n]*(?:\\(?:\n|.)[^'\\\n]*)*'")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_REGEX_BEFORE = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw))\s*$")


def _template_end(text: str, at: int) -> int:
    """Just behind the template literal that begins at ``at``, whose substitutions may hold further ones."""
    i, n, depth = at + 1, len(text), 0
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not depth:
            if c == "`":
                return i + 1
            if text.startswith("${", i):
                depth, i = 1, i + 2
                continue
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        elif c == "`":
            i = _template_end(text, i)
            continue
        elif c in "\"'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(text, i)
            i = m.end() if m else i + 1
            continue
        i += 1
    raise _Broken("unterminated literal")


def _reduce(text: str, lang: str) -> str:
    """``text`` with strings as ``"``, templates as ``t`` in signs, comments as blanks."""
    token, out, at = (_JS_TOKEN if lang == "js" else _C_TOKEN), [], 0
    while m := token.search(text, at):
        i, s = m.start(), m.group()
        out.append(text[at:i])
        if s.startswith("//"):
            at = m.end()
            continue
        if s == "/*":
            end = text.find("*/", i + 2)
            if end < 0:
                raise _Broken("unterminated comment")
            out.append("\n" if "\n" in text[i:end] else " ")
            at = end + 2
            continue
        if s == "/":
            before = text[max(0, i - 40) : i] if not out or out[-1].strip() or len(out) < 2 else out[-2][-40:] + out[-1]
            if _REGEX_BEFORE.search(before) and (r := _REGEX.match(text, i)):
                out.append(' "')
                at = r.end()
            else:
                out.append("/")
                at = i + 1
            continue
        if s == "`":
            at = _template_end(text, i)
            out.append("\x01")
            continue
        if s == '"""' and lang == "java":
            end = text.find('"""', i + 3)
            while end > 0 and text[end - 1] == "\\":
                end = text.find('"""', end + 1)
            if end < 0:
                raise _Broken("unterminated literal")
            at = end + 3
        else:
            r = (_SINGLE if s == "'" else _DOUBLE).match(text, i)
            if not r:
                raise _Broken("unterminated literal")
            at = r.end()
        out.append('"')
    out.append(text[at:])
    return "".join(out)


def _classes(words: dict[str, str]) -> Callable[[re.Match], str]:
    return lambda m: words.get(m.group(), "a")


# A class letter for each keyword; other names are "a".
_JS_WORDS = (
    dict.fromkeys("return throw new typeof delete void await yield case else do extends default".split(), "P")
    | dict.fromkeys("in of instanceof".split(), "B")
    | dict.fromkeys("let var".split(), "V")
    | dict.fromkeys("if while switch with".split(), "I")
    | dict.fromkeys("try finally".split(), "T")
    | dict.fromkeys("get set static async break continue debugger".split(), "g")
    | dict.fromkeys("import export".split(), "M")
    | {"const": "C", "function": "F", "class": "L", "for": "R", "catch": "K"}
)
_WORD = re.compile(r"[A-Za-z_$\u00aa-\uffff][\w$]*")
_NUMBER = re.compile(r"(?<![\w$])(?:0[xXbBoO][0-9A-Fa-f_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[nlLuUfFdD]*(?!\d)")

_JS_WRONG = re.compile(
    r"""[a0"\x01\]][ ](?:[a0"])|[0"][a]|a"|"["0]"""  # operands side by side
    r"""|C(?![ \n]?[a{\[])|C[ ]?a(?![ \n]?(?:[=]|B))"""
    r"""|F(?![ ]?\*?[ ]?[ag(])|F[ ]?\*?[ ]?[ag](?![ \n]?\()|L(?![ \n]?[agP{])"""
    r"""|I(?![ \n]?\()|R(?![ \n]?(?:P[ ]?)?\()|K(?![ \n]?[({])|T(?![ \n]?\{)|(?:^|[;{}\n])[ ]?M(?![ ]?[(.])"""
    r"""|[=&|*/%?][ \n]?[)\]};]|(?<![+])\+[ \n]?[)\]};]|(?<![-])-[ \n]?[)\]};]|(?<!\.)\.[ \n]?[)\]};,]|,[ \n]?;|[(\[][ \n]?(?:[,=*%.:?](?!\.\.))"""
    r"""|\][ ]?\{|=>[ \n]?[;,)]|[#@\\]|[PBICFLRKT][ ]?=(?![=>])"""
)
_JS_OPEN_END = re.compile(r"(?:[=&|*%^<?:,(\[{.~!/]|(?<!\+)\+|(?<!-)-|=>|[PBCVFLIRKTM])\s*$")


def _js(text: str) -> str | None:
    code = _reduce(re.sub(r"\A#![^\n]*", "", text), "js")
    if _MARKER.search(code):
        return "conflict marker"
    if wrong := _balance(code):
        return wrong
    code = re.sub(r"(?<=[.])(#?[A-Za-z_$][\w$]*)|#[A-Za-z_$][\w$]*(?=\s*[=;(]|\s+in\b)", "a", re.sub(r"\.\.\.", " ", code).replace("?.", "."))
    code = _NUMBER.sub("0", code)
    code = re.sub(r"\b(?:default|class|function|new|delete|in|of|if|for|case|get|set|static|import|export|const|let|var|return|try|catch|finally|with|switch|while|do|else)(?=\s*:(?!:))", lambda m: "P" if m.group() == "default" else "a", code)
    signs = _WORD.sub(_classes(_JS_WORDS), code)
    signs = re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r\f\v\xa0\ufeff]+", " ", signs)).strip()
    # Which braces open blocks, and which parentheses belong to a statement: after those a new operand may follow.
    kinds: list[str] = []
    fixed = list(signs)
    for m in _BRACKET.finditer(signs):
        c, i = m.group(), m.start()
        if c in "([":
            before = signs[:i].rstrip()[-1:] if i < 64 else signs[i - 64 : i].rstrip()[-1:]
            kinds.append("control" if c == "(" and before in ("I", "R", "K") and before else "other")
        elif c == "{":
            before = signs[max(0, i - 64) : i].rstrip()[-2:]
            block = not before or before[-1] in ");{}PT\n" and not before.endswith("P") or before == "=>" or (before[-1] in "ag" and "L" in signs[max(0, i - 200) : i])
            if before[-1:] == "{" or before[-1:] == ":":
                block = bool(kinds) and kinds[-1] == "block"
            kinds.append("block" if block else "object")
            if block and re.match(r'\{\s*"\s*:', signs[i : i + 40]):
                return "unexpected token"
        else:
            if kinds.pop() == "control":
                fixed[i] = ";"
    signs = "".join(fixed)
    if _JS_WRONG.search(signs):
        return "unexpected token"
    if _JS_OPEN_END.search(signs):
        return "premature end"
    return None


_JAVA_TOP = set("package import public private protected final abstract static class interface enum record sealed non strictfp".split())
_JAVA_KEYS = dict.fromkeys(
    "package import public private protected final abstract static class interface enum record sealed non strictfp extends implements permits throws new instanceof "
    "int long short byte char float double boolean void default synchronized volatile transient native var assert else do yield case".split(), "k"
) | dict.fromkeys("return throw break continue".split(), "S") | dict.fromkeys("if for while switch catch".split(), "I") | dict.fromkeys("try finally".split(), "T")
_C_KEYS = dict.fromkeys(
    "auto char const double enum extern float inline int long register restrict short signed sizeof static struct typedef union unsigned void volatile _Bool _Noreturn else do case default".split(), "k"
) | dict.fromkeys("return break continue goto".split(), "S") | dict.fromkeys("if for while switch".split(), "I")
_CLIKE_WRONG = re.compile(
    r"""[0][ \n]?a|"[ \n]?0|0[ \n]?"|0[ \n]0|[=+/%|?](?<!\+\+)[ \n]?[);\]]|(?<!\.)\.[ \n]?[);\]}]|,[ \n]?[;)]|={3}|=[ \n]?>|[(\[][ \n]?[,=%:?.](?!\.\.)|I(?![ \n]?\()|\bT(?![ \n]?[{(])|\\"""
)
# Type words and words that introduce a declaration; none stands before another, or before "=".
_TYPE = r"(?:void|int|long|short|byte|char|float|double|boolean)"
_JAVA_ORDER = re.compile(
    rf"\b(?:{_TYPE}|import|package|extends|implements|throws|new|return)\s+(?:class|interface|enum|public|private|protected|import|package)\b|\b{_TYPE}\s+{_TYPE}\b"
    rf"|(?<![.\w])(?:class|interface|enum)\s*(?:[^\w\s]|(?:{_TYPE}|class|interface|enum|public|private|protected|static|final|new|return|if|for|while)\b)"
    rf"|\b(?<!\.)(?:{_TYPE}|class|new|extends|return|if|for|while|import|package|public|private|protected|static|final|abstract|throws)\s*=(?!=)"
)
_C_ORDER = re.compile(r"\b(?:void|int|long|short|char|float|double|struct|union|enum|return|if|for|while|switch|else|do|goto|static|extern|typedef|sizeof|break|continue)\s*=(?!=)|\b(?:struct|union|enum|goto)\s+(?:return|if|for|while|int|char|void|struct|union|enum|static)\b")
_JAVA_WRONG = re.compile(r"""[#`]|"[ \n]?[a"]|a[ \n]?"|a[ \n]a[ \n]a""")
_C_WRONG = re.compile(r"""[@`$]|a[ \n]a[ \n]a[ \n]a""")
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\n\\]|\\\n|\\.)*)", re.M)
# The directives of the preprocessor.
_DIRECTIVES = set("include define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma embed".split()) | {""}


def _directives(text: str) -> str:
    open_ifs = 0
    for name, rest in _DIRECTIVE.findall(text):
        if name not in _DIRECTIVES or (not name and rest.strip()):
            raise _Broken("unexpected token")
        if name in ("if", "ifdef", "ifndef"):
            open_ifs += 1
        elif name == "endif":
            open_ifs -= 1
            if open_ifs < 0:
                raise _Broken("unbalanced delimiter")
    if open_ifs:
        raise _Broken("premature end")
    return _DIRECTIVE.sub(";", text)


def _clike(text: str, lang: str) -> str | None:
    code = _reduce(text, lang)
    if _MARKER.search(code):
        return "conflict marker"
    if lang == "c":
        code = _directives(code)
    if wrong := _balance(code):
        return wrong
    signs = _NUMBER.sub("0", code)
    if (_JAVA_ORDER if lang == "java" else _C_ORDER).search(signs):
        return "unexpected token"
    top = signs
    signs = _WORD.sub(_classes(_JAVA_KEYS if lang == "java" else _C_KEYS), signs)
    signs = re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r\f\v\ufeff]+", " ", signs)).strip()
    if _CLIKE_WRONG.search(signs) or (_JAVA_WRONG if lang == "java" else _C_WRONG).search(signs):
        return "unexpected token"
    kinds: list[str] = []
    fixed = list(signs)
    for m in _BRACKET.finditer(signs):
        c, i = m.group(), m.start()
        before = signs[max(0, i - 64) : i].rstrip()[-1:]
        if c == "(":
            kinds.append("control" if before == "I" else "other")
        elif c == "[":
            kinds.append("other")
        elif c == "{":
            kinds.append("block" if before in (")", "T") and before else "other")
        else:
            kind = kinds.pop()
            if kind == "control":
                fixed[i] = ";"
            elif kind == "block" and before in ("a", "0", '"', ")", "]") and fixed[len(signs[:i].rstrip()) - 1] != ";":
                return "unexpected token"
    signs = "".join(fixed)
    if re.search(r"""[a0")\]][ \n](?:S|I(?=[ \n]?\()|T)""", signs):
        return "unexpected token"
    if signs and signs[-1] not in ";}":
        return "premature end"
    # At the top level only declarations may stand.
    depth, start, flat = 0, 0, []
    for m in re.finditer(r"[{}]", top):
        if m.group() == "{":
            if not depth:
                flat.append(top[start : m.start()] + "{")
            depth += 1
        else:
            depth -= 1
            if not depth:
                start = m.end()
                flat.append("}")
    flat.append(top[start:])
    for piece in re.split(r";|\}", "".join(flat)):
        words = piece.split()
        if not words:
            continue
        if lang == "java":
            first = re.match(r"[A-Za-z_]*", words[0]).group()
            if first not in _JAVA_TOP and words[0][0] != "@":
                return "unexpected token"
        elif words[0][0] in "{[0\"=.:(" or re.search(r"[:?\"]|(?<![\d.])\.(?![.\d])", piece.split("=")[0].split("(")[0]):
            return "unexpected token"
    return None


# --- Python -------------------------------------------------------------------------------------------------

_PY_TOKEN = re.compile(r"#[^\n]*|(?<![\w])(?:[rRbBuUfFtT]{1,2})?(\"\"\"|'''|\"|')|(?<=[\w])(\"\"\"|'''|\"|')")
_PY_WORDS = (
    dict.fromkeys("and or in is as if else for".split(), "B")
    | dict.fromkeys("return raise del assert import from global nonlocal yield await async lambda with while elif try except finally def class".split(), "k")
    | dict.fromkeys("pass break continue".split(), "s")
    | {"not": "N"}
)
_PY_OP = re.compile(r"==|!=|<=|>=|//=?|\*\*=|<<=?|>>=?|:=|->|[+\-*/%&|^@]=")
_PY_WRONG = re.compile(
    r"""[a0)\]}s][ ]?[a0"]|"[ ]?[a0]|(?:^|[ ])s[ ]?[^; ]|[=O+\-/%&|^<>.~][ ]?[)\]}]|\.[ ]?[^a. ]|[=O<>][ ]?[=O<>/%&|^,]|[(\[{][ ]?[,=O/%&|^<>.]|,[ ]?,|[^\w\s"=+\-*/%&|^<>~.,:;()\[\]{}@]"""
    r"""|B[ ]?[)\]}=O]|N[ ]?[)\]}=]|k[ ]?=|[=O+\-*/%&|^<>~.@][ ]?$|^[ ]?[=O/%&|^<>.,)\]}:]"""
)
#: A call or a literal before "=" at the top of a statement.
_PY_TARGET = re.compile(r"[\w\])] ?\(\) ?=(?!=)|(?:^|[,=] ?)(?:\d[\w.]*|\"+|None|True|False) ?=(?!=)")
_PY_COMPOUND = re.compile(r"(?:async )?(if|elif|else|while|for|with|def|class|try|except|finally)\b")
_PY_SOFT = re.compile(r"(?:match|case) [^=].*:$|type \w+ ?(?:\[\])? ?=|case .*:")
_PY_BLANKS = re.compile(r"[ \t]+")
_PY_STAR = re.compile(r"(?<=[(,\[{ =k])\*{1,2}(?=[ ]?[a(\"{\[])|^\*(?=a)")
_PY_BARE = re.compile(r"from\b(?! [.\w ]+ import (?:\(|\*|\w))|import\b(?! ?\w)|(?:def|class|del|global|nonlocal|import|assert|for|with|while|if|elif) *$")
_PY_DEF = re.compile(r"(?:async )?def \w+ ?(?:\[\] ?)?\(\) ?(?:->[^:]*)?:")
_PY_CLASS = re.compile(r"class \w+ ?(?:\[\] ?)?(?:\(\) ?)?:")
_PY_LEAD = re.compile(r"[ \t]*")
_PY_FOLLOW = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "try", "except"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}


def _py_reduce(text: str) -> str:
    out, at = [], 0
    while m := _PY_TOKEN.search(text, at):
        out.append(text[at : m.start()])
        quote = m.group(1) or m.group(2)
        if not quote:
            at = m.end()
            continue
        i = m.end()
        while True:
            end = text.find(quote, i)
            if end < 0:
                raise _Broken("unterminated literal")
            if len(quote) == 1 and (nl := text.find("\n", i, end)) >= 0 and text[nl - 1 : nl] != "\\":
                raise _Broken("unterminated literal")
            back = end
            while back > m.end() and text[back - 1] == "\\":
                back -= 1
            if (end - back) % 2 == 0:
                break
            i = end + 1
        out.append('"')
        at = end + len(quote)
    out.append(text[at:])
    return "".join(out)


def _python(text: str) -> str | None:
    code = _py_reduce(text)
    if _MARKER.search(code):
        return "conflict marker"
    if wrong := _balance(code):
        return wrong
    code = code.replace("\\\n", " ").replace("\f", "")
    # Lines inside brackets are one; `flat` leaves out what brackets hold.
    lines, flats, depth, at = [[]], [[]], 0, 0
    for m in re.finditer(r"[()\[\]{}\n]", code):
        c, part = m.group(), code[at : m.start()]
        lines[-1].append(part)
        if not depth:
            flats[-1].append(part)
        if c == "\n":
            if depth:
                lines[-1].append(" ")
            else:
                lines.append([])
                flats.append([])
        else:
            lines[-1].append(c)
            if c in "([{":
                flats[-1] += [c] if not depth else []
                depth += 1
            else:
                depth -= 1
                flats[-1] += [c] if not depth else []
        at = m.end()
    lines[-1].append(code[at:])
    flats[-1].append(code[at:])
    indents, last_kind, opened = [0], {0: ""}, False
    for parts, flat_parts in zip(lines, flats):
        raw = "".join(parts)
        line = raw.strip()
        if not line:
            continue
        lead = _PY_LEAD.match(raw).group()
        width = len(lead.expandtabs(8))
        if opened:
            if width <= indents[-1]:
                return "premature end"
            indents.append(width)
        elif width > indents[-1]:
            return "unexpected token"
        while width < indents[-1]:
            gone = indents.pop()
            if last_kind.pop(gone, "") == "try":
                return "unexpected token"
        if width != indents[-1]:
            return "unexpected token"
        flat = "".join(flat_parts).strip()
        head = _PY_COMPOUND.match(flat)
        kind = head.group(1) if head else ""
        before = last_kind.get(width, "")
        if kind in _PY_FOLLOW and before not in _PY_FOLLOW[kind] or before == "try" and kind not in ("except", "finally"):
            return "unexpected token"
        last_kind[width] = kind
        opened = False
        soft = _PY_SOFT.match(flat)
        if head:
            if kind == "def":
                end = _PY_DEF.match(flat)
            elif kind == "class":
                end = _PY_CLASS.match(flat)
            elif kind in ("else", "try", "finally"):
                end = re.match(r"\w+ ?:", flat)
            elif kind == "for":
                end = re.match(r"(?:async )?for .+? in .+?:", flat)
            else:
                end = re.match(r"(?:async )?\w+\*? ?.*:" if kind in ("except",) else r"(?:async )?\w+ ?.+:", flat)
            if not end:
                return "unexpected token"
            opened = flat.endswith(":")
        elif soft:
            opened = flat.endswith(":")
            line = re.sub(r"^(?:match|case|type) ", "return ", line)
        elif flat.endswith(":") or "lambda" in line and re.search(r"\blambda\b(?![^:]*:)", line):
            return "unexpected token"
        elif ":" in flat and "lambda" not in flat and ":=" not in flat and not re.match(r"[\w.()\[\]]+ ?: ?[^:]+$", flat):
            return "unexpected token"
        elif ":" not in flat.split("=")[0] and _PY_TARGET.search(flat):
            return "unexpected token"
        signs = _WORD.sub(_classes(_PY_WORDS), _NUMBER.sub("0", line.replace("...", " a ")))
        signs = _PY_BLANKS.sub(" ", _PY_OP.sub("O", signs))
        if signs[0] == "@":
            signs = signs[1:].strip()
        if "*" in signs or "/" in signs:
            signs = _PY_STAR.sub("", signs).replace("(/,", "(").replace("/)", ")").replace("/,", "").replace("(*,", "(").replace(",*,", ",").replace(", *,", ",")
        body = signs.rstrip(":").rstrip() if signs.endswith(":") else signs
        if body and _PY_WRONG.search(body):
            return "unexpected token"
        if _PY_BARE.match(line):
            return "unexpected token"
        if body and (body[-1] in "BN" or body[-1] == "k" and re.search(r"\b(?:from|import|del|assert|global|nonlocal|await|lambda|as) *$", line)):
            return "premature end"
        if not kind and " if " in line and " for " not in line and len(re.findall(r"\bif\b", line)) > len(re.findall(r"\belse\b", line)):
            return "premature end"
    if opened or last_kind.get(0) == "try" or any(last_kind.get(i) == "try" for i in indents):
        return "premature end"
    return None


# --- shell --------------------------------------------------------------------------------------------------

_SH_TOKEN = re.compile(r"\\(?:.|\n)|'|\"|`|\$\(\(|\$\(|\$\{|\$'|<<-?[ \t]*(?:'[^'\n]+'|\"[^\"\n]+\"|\\?[\w.-]+)|(?<![^\s;&|()`])#[^\n]*|&&|\|\||;;&?|;&|[;&|()\n]|<<<|[<>]|[^\s;&|()'\"`\\$<>]+|\$|[ \t\r]+")
_SH_OPEN = {"if": "fi", "case": "esac", "do": "done", "{": "}"}


def _sh_double(text: str, i: int) -> int:
    """Just behind the double-quoted string whose content begins at ``i``."""
    n = len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == '"':
            return i + 1
        elif text.startswith("$(", i):
            i = _sh_substitution(text, i + 2)
        elif text.startswith("${", i):
            i = _sh_braces(text, i + 2)
        elif c == "`":
            end = text.find("`", i + 1)
            if end < 0:
                raise _Broken("unterminated literal")
            i = end + 1
        else:
            i += 1
    raise _Broken("unterminated literal")


def _sh_braces(text: str, i: int) -> int:
    n = len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "}":
            return i + 1
        elif c == '"':
            i = _sh_double(text, i + 1)
        elif c == "'":
            end = text.find("'", i + 1)
            if end < 0:
                raise _Broken("unterminated literal")
            i = end + 1
        elif text.startswith("${", i):
            i = _sh_braces(text, i + 2)
        elif text.startswith("$(", i):
            i = _sh_substitution(text, i + 2)
        else:
            i += 1
    raise _Broken("premature end")


def _sh_substitution(text: str, i: int) -> int:
    """Just behind the ``)`` of a command substitution or arithmetic whose content begins at ``i``."""
    depth, n = 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == '"':
            i = _sh_double(text, i + 1)
            continue
        if c == "'":
            end = text.find("'", i + 1)
            if end < 0:
                raise _Broken("unterminated literal")
            i = end + 1
            continue
        if text.startswith("${", i):
            i = _sh_braces(text, i + 2)
            continue
        depth += (c == "(") - (c == ")")
        i += 1
        if not depth:
            return i
    raise _Broken("premature end")


def _shell(text: str) -> str | None:
    stack: list[str] = []
    at, n = 0, len(text)
    command, word, heredocs = True, "", []
    expect_in = expect_do = False
    line_start = True
    just_opened = False  # a compound that needs a command before its next part

    def close(what: str) -> None:
        if not stack or stack.pop() != what:
            raise _Broken("unbalanced delimiter")

    first_word = ""
    patterns = 0  # words since the last bar in the pattern of a case
    while at < n:
        if line_start and (m := _MARKER.match(text, at)):
            return "conflict marker"
        line_start = False
        m = _SH_TOKEN.match(text, at)
        if not m:
            at += 1
            continue
        t = m.group()
        at = m.end()
        if t[0] in " \t\r":
            if word:
                word = ""
            continue
        if t[0] == "#":
            if not word:
                continue
            word += t
            continue
        if t == "\n" or t in (";", "&", "|", "&&", "||", ";;", ";;&", ";&"):
            if t == "\n":
                for tag in heredocs:
                    strip = tag.startswith("-")
                    m = re.compile(rf"^{'[ \t]*' if strip else ''}{re.escape(tag.lstrip('-'))}[ \t]*$", re.M).search(text, at)
                    at = m.end() if m else n
                heredocs = []
                line_start = True
            elif command and t not in (";;", ";&", ";;&") and (just_opened or not first_word or t != ";"):
                if not (stack and stack[-1] == "esac"):
                    return "unexpected token"
            if t in (";;", ";;&", ";&"):
                if not stack or stack[-1] != "esac-body":
                    return "unexpected token"
                stack[-1] = "esac"
            command, word, patterns = True, "", 0
            continue
        if t[0] in "'\"`$\\" or t == "$'":
            if t == "'" or t == "$'":
                end = text.find("'", at)
                if t == "$'":
                    while end > 0 and text[end - 1] == "\\":
                        end = text.find("'", end + 1)
                if end < 0:
                    return "unterminated literal"
                at = end + 1
            elif t == '"':
                at = _sh_double(text, at)
            elif t == "`":
                end = text.find("`", at)
                if end < 0:
                    return "unterminated literal"
                at = end + 1
            elif t in ("$(", "$(("):
                at = _sh_substitution(text, at - (t == "$((")) if t == "$(" else _sh_substitution(text, m.start() + 2)
            elif t == "${":
                at = _sh_braces(text, at)
            new = not word
            word += "\x00"
            if stack and stack[-1] == "esac" and not expect_in:
                patterns += new
                if patterns > 1:
                    return "unexpected token"
                continue
            if command:
                command, first_word, just_opened = False, "\x00", False
            continue
        if t.startswith("<<") and t != "<<<":
            tag = t[2:].lstrip("-").strip().strip("'\"\\")
            heredocs.append(("-" if t[2:3] == "-" else "") + tag)
            word = ""
            continue
        if t in ("<", ">", "<<<"):
            word = ""
            continue
        if t == "(":
            if word.endswith("=") or word.endswith("+="):
                stack.append("array")
                command = False
                word = ""
                continue
            if stack and stack[-1] == "esac" and not word:
                continue
            if word and not command or (word and first_word == word):
                rest = re.compile(r"[ \t]*\)[ \t\n]*").match(text, at)
                if not rest or first_word != word:
                    return "unexpected token"
                at = rest.end()
                command, word, first_word = True, "", ""
                continue
            if not command:
                rest = re.compile(r"[ \t]*\)").match(text, at)
                return "unexpected token" if not rest or first_word in ("", "\x00") else "unexpected token"
            if text.startswith("(", at):
                at = _sh_substitution(text, at)
                command = False
                continue
            stack.append(")")
            command, word = True, ""
            continue
        if t == ")":
            if stack and stack[-1] == "esac":
                stack[-1] = "esac-body"
                command, word, patterns = True, "", 0
                continue
            if stack and stack[-1] == "array":
                stack.pop()
                continue
            close(")")
            command, word, first_word = False, "", "x"
            continue
        # an ordinary word
        new = not word
        word += t
        if stack and stack[-1] == "array":
            continue
        if not new:
            if command is False and first_word and first_word == word[: -len(t)]:
                first_word = word
            continue
        if expect_in and t == "in":
            expect_in = False
            if stack and stack[-1] == "esac":
                command = True
            continue
        if stack and stack[-1] == "esac" and not expect_in:
            if t == "esac" and not patterns:
                stack.pop()
                command, first_word = False, "x"
                continue
            patterns += 1
            if patterns > 1:
                return "unexpected token"
            continue
        if not command:
            continue
        if t in ("if", "while", "until"):
            stack.append("then" if t == "if" else "do")
            just_opened = True
        elif t == "for" or t == "select":
            stack.append("do")
            expect_do, command, first_word = True, False, "for"
            expect_in = True
        elif t == "case":
            stack.append("esac")
            expect_in, command, first_word = True, False, "case"
        elif t == "then":
            if not stack or stack[-1] != "then" or just_opened:
                return "unexpected token"
            stack[-1] = "fi"
            just_opened = True
        elif t in ("else", "elif"):
            if not stack or stack[-1] != "fi" or just_opened:
                return "unexpected token"
            stack[-1] = "fi" if t == "else" else "then"
            just_opened = True
        elif t == "fi":
            if just_opened:
                return "unexpected token"
            close("fi")
            command, first_word = False, "x"
        elif t == "do":
            if not stack or stack[-1] != "do" or just_opened:
                return "unexpected token"
            stack[-1] = "done"
            just_opened = True
            expect_in = False
        elif t == "done":
            if just_opened:
                return "unexpected token"
            close("done")
            command, first_word = False, "x"
        elif t == "esac":
            if stack and stack[-1] == "esac-body":
                stack.pop()
                command, first_word = False, "x"
            else:
                return "unbalanced delimiter"
        elif t == "{":
            stack.append("}")
            just_opened = True
        elif t == "}":
            if just_opened:
                return "unexpected token"
            close("}")
            command, first_word = False, "x"
        elif t in ("!", "time"):
            pass
        elif re.fullmatch(r"[A-Za-z_]\w*\+?=.*", t) and not text.startswith("(", at):
            command, first_word, just_opened = True, "", False
        else:
            command, first_word, just_opened = False, t, False
            if t == "function":
                command = True
    return "premature end" if stack else None


# --- data languages -----------------------------------------------------------------------------------------

_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+-])|(true|false|null)(?!\w)|([{}\[\],:]))')


def _json(text: str) -> str | None:
    """Strict JSON: one value, the stack holding what may follow."""
    at, n, stack, expect = 0, len(text), [], "value"
    end = len(text.rstrip(" \t\n\r"))
    if text.startswith("\ufeff"):
        return "unexpected token"
    while at < end:
        m = _JSON_TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip(" \t\n\r")
            if _MARKER.match(rest):
                return "conflict marker"
            return "unterminated literal" if rest[:1] == '"' else "unexpected token"
        at = m.end()
        string, number, name, sign = m.groups()
        if expect == "end":
            return "unexpected token"
        if string is not None or number is not None or name is not None:
            if expect in ("key", "key or }"):
                if string is None:
                    return "unexpected token"
                expect = ":"
                continue
            if expect not in ("value", "value or ]"):
                return "unexpected token"
            expect = ", or close" if stack else "end"
        elif sign in "{[":
            if expect not in ("value", "value or ]"):
                return "unexpected token"
            stack.append(sign)
            expect = "key or }" if sign == "{" else "value or ]"
        elif sign == ":":
            if expect != ":":
                return "unexpected token"
            expect = "value"
        elif sign == ",":
            if expect != ", or close":
                return "unexpected token"
            expect = "key" if stack[-1] == "{" else "value"
        else:
            if not stack or stack.pop() != _PAIRS[sign] or expect not in (", or close", "key or }" if sign == "}" else "value or ]"):
                return "unbalanced delimiter"
            expect = ", or close" if stack else "end"
    return None if expect == "end" else "premature end"


_TOML_KEY = r"(?:[A-Za-z0-9_-]+|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\n]*')"
_TOML_KEYS = rf"{_TOML_KEY}(?:[ \t]*\.[ \t]*{_TOML_KEY})*"
_TOML_HEADER = re.compile(rf"\[\[[ \t]*{_TOML_KEYS}[ \t]*\]\]|\[[ \t]*{_TOML_KEYS}[ \t]*\]")
_TOML_ASSIGN = re.compile(rf"{_TOML_KEYS}[ \t]*=[ \t]*")
_TOML_SCALAR = re.compile(
    r"\"\"\"(?:[^\\]|\\.)*?\"\"\"\"{0,2}(?!\")|'''.*?'''|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\n]*'|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?"
    r"|0x[0-9A-Fa-f_]+|0o[0-7_]+|0b[01_]+|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d+)?|true|false",
    re.S,
)
_TOML_BLANK = re.compile(r"(?:[ \t\r\n]|#[^\n]*)*")


def _toml_value(text: str, at: int) -> int:
    """Just behind the value at ``at``; arrays and inline tables go onto the stack."""
    stack: list[str] = []
    fresh = True  # a value is expected
    while True:
        at = _TOML_BLANK.match(text, at).end() if stack and stack[-1] == "[" else re.compile(r"[ \t]*").match(text, at).end()
        c = text[at : at + 1]
        if not c:
            raise _Broken("premature end")
        if stack and c == ("]" if stack[-1] == "[" else "}") and (stack[-1] == "[" or fresh != "comma"):
            stack.pop()
            at += 1
        elif fresh:
            if stack and stack[-1] == "{" and fresh in (True, "comma"):
                m = _TOML_ASSIGN.match(text, at)
                if not m:
                    raise _Broken("unexpected token")
                at, fresh = m.end(), "value"
                continue
            if c in "[{":
                stack.append(c)
                at, fresh = at + 1, True
                continue
            m = _TOML_SCALAR.match(text, at)
            if not m or re.match(r"[\w+.]", text[m.end() : m.end() + 1]):
                raise _Broken("unterminated literal" if c in "\"'" else "unexpected token")
            at = m.end()
        else:
            if c != ",":
                raise _Broken("unexpected token")
            at, fresh = at + 1, "comma"
            if stack[-1] == "[":
                fresh = True
            continue
        fresh = False
        if not stack:
            return at


def _toml(text: str) -> str | None:
    at, n = 0, len(text)
    while True:
        at = _TOML_BLANK.match(text, at).end()
        if at >= n:
            return None
        if _MARKER.match(text, at):
            return "conflict marker"
        m = _TOML_HEADER.match(text, at)
        if m:
            at = m.end()
        else:
            m = _TOML_ASSIGN.match(text, at)
            if not m:
                return "premature end" if "\n" not in text[at:] else "unexpected token"
            at = _toml_value(text, m.end())
        rest = re.compile(r"[ \t\r]*(?:#[^\n]*)?(?:\n|\Z)").match(text, at)
        if not rest:
            return "unexpected token"
        at = rest.end()


_YAML_KEY = re.compile(r"(?:\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\n]*'|[^\s#\-?:,\[\]{}&*!|>'\"%@`][^\n#]*?|[\-?:](?=\S)[^\n#]*?|<<)[ \t]*:(?=[ \t]|$)")
_YAML_BLOCK = re.compile(r"[|>][0-9+-]*[ \t]*(?:#.*)?$")


def _yaml(text: str) -> str | None:
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    levels: list[tuple[int, str]] = []  # (indent, "map" | "seq")
    scalar_indent = -1  # a plain scalar that may go on below
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        i += 1
        body = line.strip()
        if not body or body[0] == "#":
            if body:
                scalar_indent = -1
            continue
        if _MARKER.match(line):
            return "conflict marker"
        indent = len(line) - len(line.lstrip(" "))
        if line[indent : indent + 1] == "\t":
            return "unexpected token"
        if indent == 0 and (body == "..." or re.match(r"---(?: |$)", body) or body[0] == "%"):
            levels, scalar_indent = [], -1
            if not body.startswith("--- "):
                continue
            body = body[4:].strip()
        if scalar_indent >= 0 and indent > scalar_indent:
            if re.search(r":(?: |$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", body)):
                return "unexpected token"
            continue
        if scalar_indent == -2 and not levels:  # a document that is one scalar
            if re.search(r":(?: |$)", body):
                return "unexpected token"
            continue
        scalar_indent = -1
        while levels and indent < levels[-1][0]:
            levels.pop()
        at = indent
        while True:
            dash = re.match(r"-(?: +|$)", body)
            kind = "seq" if dash else "map"
            if not dash and not _YAML_KEY.match(body):
                if levels and levels[-1][0] >= at and at == indent:
                    return "unexpected token"
                break
            if not levels or at > levels[-1][0]:
                levels.append((at, kind))
            elif levels[-1][0] == at and levels[-1][1] != kind:
                if kind == "seq" and levels[-1][1] == "map":
                    levels.append((at, "seq"))
                elif len(levels) > 1 and levels[-2] == (at, kind):
                    levels.pop()
                else:
                    return "unexpected token"
            elif levels[-1][0] != at:
                return "unexpected token"
            if not dash:
                break
            at += dash.end()
            body = body[dash.end() :]
            if not body:
                break
        value = body
        own = levels[-1][0] if levels else -1
        if m := _YAML_KEY.match(body):
            value = body[m.end() :].strip()
        value = re.sub(r"^(?:[&!][^\s]*\s*)+", "", value)
        if not value or value[0] == "#":
            continue
        if _YAML_BLOCK.match(value):
            while i < n and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > own):
                i += 1
            continue
        if value[0] in "\"'":
            quoted = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", re.S)
            rest = "\n".join([value, *lines[i:]])
            q = quoted.match(rest)
            if not q:
                return "unterminated literal"
            i += q.group().count("\n")
            tail = rest[q.end() :].split("\n")[0].strip()
            if tail and tail[0] != "#":
                return "unexpected token"
            continue
        if value[0] in "[{":
            rest = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", lambda q: '"' + "\n" * q.group().count("\n"), "\n".join([value, *lines[i:]]), flags=re.S)
            depth = 0
            for m in _BRACKET.finditer(rest):
                depth += 1 if m.group() in "([{" else -1
                if depth <= 0:
                    break
            if depth:
                return "premature end"
            i += rest[: m.end()].count("\n")
            tail = rest[m.end() :].split("\n")[0].strip()
            if tail and tail[0] != "#":
                return "unexpected token"
            continue
        if value[0] in "@`%" or re.search(r":(?: |$)", value) and _YAML_KEY.match(body):
            return "unexpected token"
        scalar_indent = own if levels else -2
    return None


def _clean(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


# --- other languages ----------------------------------------------------------------------------------------

_PLAIN_TOKEN = re.compile(r"//[^\n]*|/\*|\"\"\"|(?:\bR)\"([^\s()\\]{0,16})\(|\br(#*)\"|@\"|\"|`|'(?:\\(?:u\{[^}]*\}|.[^'\n]{0,8})|[^\\'\n])'")


def _plain(text: str) -> str | None:
    """What holds of any language with C's comments and delimiters: literals and comments end, delimiters match."""
    out, at = [], 0
    while m := _PLAIN_TOKEN.search(text, at):
        i, t = m.start(), m.group()
        out.append(text[at:i])
        at = m.end()
        if t.startswith("//") or t[0] == "'":
            continue
        if t == '"':
            r = re.compile(r'[^"\\]*(?:\\(?s:.)[^"\\]*)*"').match(text, at)
            end = r.end() if r else -1
        elif t == '@"':
            r = re.compile(r'[^"]*(?:""[^"]*)*"').match(text, at)
            end = r.end() if r else -1
        else:
            close = {"/*": "*/", '"""': '"""', "`": "`"}.get(t) or (f'){m[1]}"' if m[1] is not None else '"' + m[2])
            found = text.find(close, at)
            end = found + len(close) if found >= 0 else -1
        if end < 0:
            return "unterminated comment" if t == "/*" else "unterminated literal"
        at = end
        out.append(" ")
    out.append(text[at:])
    code = "".join(out)
    return "conflict marker" if _MARKER.search(code) else _balance(code)


def _typed_js(text: str) -> str | None:
    """TypeScript: literals, comments and delimiters as in JavaScript, the grammar of types left open."""
    code = _reduce(re.sub(r"\A#![^\n]*", "", text), "js")
    return "conflict marker" if _MARKER.search(code) else _balance(code)


def _marked(text: str) -> str | None:
    """Languages whose literals are not known here: only a whole set of conflict markers tells."""
    return "conflict marker" if re.search(r"^<{7} .*?^={7}$.*?^>{7} ", text, re.M | re.S) else None


_LEXERS: dict[str, Callable[[str], str | None]] = {
    "py": _python,
    "js": _js,
    "java": lambda t: _clike(t, "java"),
    "c": lambda t: _clike(t, "c"),
    "sh": _shell,
    "json": _json,
    "toml": _toml,
    "yaml": _yaml,
}
_LEXERS |= {"pyi": _python, "mjs": _js, "cjs": _js, "bash": _shell, "yml": _yaml, "ts": _typed_js, "mts": _typed_js, "cts": _typed_js}
_LEXERS |= dict.fromkeys("go rs h hh hpp cc cpp cxx cs kt kts scala swift".split(), _plain)
_LEXERS |= dict.fromkeys("tsx jsx rb php pl r sql lua tf cfg ini css scss xml html vue gradle dart ex exs hs ml clj el zig".split(), _marked)
LANGUAGES = tuple(_LEXERS)


def verdict(lang: str, text: str) -> str | None:
    """None if ``text`` is valid as far as its lexer can tell, or if the language is not known; else the reason."""
    lexer = _LEXERS.get(lang)
    if lexer is None or not text:
        return None
    text = _clean(text)
    try:
        return lexer(text)
    except _Broken as broken:
        return str(broken)
    except RecursionError:
        return "nesting beyond any parser"
