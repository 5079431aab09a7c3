"""Problem 5: HTML, Markdown, wiki and LaTeX markup into clean text that keeps its structure.

Each body becomes a token stream in one form of notation: ``#`` headings, ``-`` lists, ``|`` tables, fenced
code, ``$`` formulas. The streams of a host (the top folder of the notes' paths) are concatenated, a suffix
array over their words finds long substrings that repeat on distinct pages, and what they cover is removed
from all pages but the first. A host's array is built over blocks of bounded size, to which rows and not pages are
dealt, so neither a large host nor a page that holds a third of all rows meets in one task. What repeats across
blocks is sought by sampled fingerprints, counted by a combinable aggregate, and then compared whole: the size of
the blocks changes no text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut

#: Words of a substring that counts as boilerplate when it repeats.
REPEAT_WORDS = 24
#: Characters of the bodies that one suffix array covers.
BLOCK_CHARS = 4_000_000

# The elements of HTML, by what they become.
_BLOCK_TAGS = "p|div|section|article|header|footer|main|nav|aside|blockquote|ul|ol|dl|dt|dd|table|thead|tbody|tfoot|form|fieldset|figure|figcaption|center|address|details|summary|hr"
_INLINE_TAGS = "a|abbr|acronym|b|bdi|bdo|big|button|cite|code|data|del|dfn|em|font|i|img|input|ins|kbd|label|mark|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr|iframe|svg|path|object|param|video|audio|source|select|option|textarea"
_STRUCTURE_TAGS = "h[1-6]|li|tr|td|th|br|caption|colgroup|col|html|head|body|title|meta|link|pre|script|style|noscript"
_TAG = re.compile(rf"(?i)<(/?)({_BLOCK_TAGS}|{_INLINE_TAGS}|{_STRUCTURE_TAGS})((?:\s+[a-z_:@][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*)\s*(/?)>|<!(?:DOCTYPE|doctype)[^<>]*>")
_HTML_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

_FENCE = re.compile(r"^[ ]{0,3}(```+|~~~+)[ \t]*([\w+#.-]*)[^\n`]*\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"(?i)<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(.*?)(?:</code>\s*)?</pre>", re.S)
_CODE = re.compile(r"(?i)<(code|kbd|samp|tt)\b[^<>]*>(.*?)</\1>", re.S)
_WIKI_CODE = re.compile(r"(?i)<(syntaxhighlight|source|nowiki)\b[^<>]*>(.*?)</\1>", re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(.*?)\\end\{\1\}", re.S)
_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)(?<!`)\1(?!`)")
_ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?-----END [A-Z0-9 ]+-----", re.S)

_DISPLAY = re.compile(r"\\\[(.+?)\\\]|\$\$(.+?)\$\$|\\begin\{(equation|align|gather|multline|displaymath|eqnarray|math)(\*?)\}(.*?)\\end\{\3\4\}", re.S)
_INLINE_MATH = re.compile(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])([^$\n]+?)(?<=[^\s\\$])\$(?![\d\w$])", re.S)
_MATHS = re.compile(r"\\[A-Za-z]+|[\^_](?:\{|[A-Za-z0-9])|^[A-Za-z](?:\s*[=<>+\-*/]\s*[\w.\\]+)*$")
# The commands of LaTeX that stand in running text.
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
_STYLE = re.compile(r"\\(?:textbf|textit|emph|texttt|textsc|textsf|textrm|textsl|underline|text|mbox|caption|footnote|url|enquote)\{([^{}]*)\}")
_MENTION = re.compile(r"~?\\(?:cite[tp]?|ref|eqref|pageref|autoref|cref|Cref|label|bibliography|bibliographystyle|input|include|includegraphics|usepackage|documentclass|author|date|vspace|hspace|index)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
_HREF = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
_ENVIRONMENT = re.compile(r"^[ \t]*\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})*[ \t]*\n?|\\(?:begin|end)\{[A-Za-z]+\*?\}", re.M)
_ITEM = re.compile(r"^[ \t]*\\item\b(?:\[([^\]]*)\])?[ \t]*", re.M)
_BREAKS = re.compile(r"\\(?:maketitle|tableofcontents|newpage|clearpage|noindent|centering|hline|par|bigskip|medskip|smallskip)\b")

_WIKI_TABLE = re.compile(r"^\{\|(.*?)^\|\}[ \t]*$", re.M | re.S)
_WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]+)\]\]")
_WIKI_URL = re.compile(r"(?<!\[)\[(?:https?|ftp|mailto):[^\s\[\]]+[ \t]+([^\[\]\n]+)\](?!\()")
_TEMPLATE = re.compile(r"\{\{\s*[A-Za-z#][^{}\n|]*(?:\|[^{}]*)?\}\}")
_WIKI_EMPH = re.compile(r"(?<!')('{5}|'''|'')(?=[^'\s])([^\n]*?[^'\s])\1(?!')")
_REDIRECT = re.compile(r"(?im)^#REDIRECT\b")

_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)(?:[ \t]+#+)?[ \t]*$", re.M)
_SETEXT = re.compile(r"^(?! {0,3}(?:[-*+>|#=]|\d+\.)[ \t|])[ \t]*(\S[^\n]*)\n {0,3}(=+|-{2,})[ \t]*$", re.M)
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_BULLET = re.compile(r"^([ \t]*)[-*+][ \t]+(?=\S)", re.M)
_NUMBERED = re.compile(r"^([ \t]*)(\d{1,9})\.[ \t]+(?=\S)", re.M)
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?=\S)", re.M)
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\((?:<[^<>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)")
_REF_LINK = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_REF_DEF = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\S+(?:[ \t]+\"[^\"\n]*\")?[ \t]*$\n?", re.M)
_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_STRONG = re.compile(r"(?<![*\w\\])(\*\*\*|\*\*|\*)(?=[^\s*])([^*\n]*?[^\s*\\])\1(?![*\w])|(?<![_\w\\])(___|__|_)(?=[^\s_])([^\n]*?[^\s_\\])\3(?![_\w])")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~")
_TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-+:?[ \t]*\|[ \t]*$", re.M)


def convert(body: str) -> tuple[list[str], str]:
    """(kinds of markup that occur, clean text) of one body.

    Code is taken out first and put back last, so no sign inside it counts as markup; then formulas, for the
    same reason. The order of the rest is that in which one notation may stand inside another.
    """
    kinds: set[str] = set()
    held: list[str] = []
    text = body.replace("\r\n", "\n").replace("\r", "\n").replace("\ue000", "").replace("\ue001", "")

    def hold(value: str) -> str:
        held.append(value)
        return f"\ue000{len(held) - 1}\ue001"

    def fenced(code: str, lang: str = "") -> str:
        return hold(f"```{lang}\n{code.strip(chr(10))}\n```")

    def strip_tags(code: str) -> str:
        return html.unescape(_TAG.sub("", code))

    def mark(kind: str, value: str) -> str:
        kinds.add(kind)
        return value

    if "-----BEGIN" in text:
        text = _ARMOUR.sub(lambda m: hold(m.group()), text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(lambda m: mark("markdown", fenced(m[3], m[2]) + "\n"), text)
    if "<" in text:
        text = _WIKI_CODE.sub(lambda m: mark("wiki", fenced(m[2]) if "\n" in m[2] else hold(m[2])), text)
        text = _PRE.sub(lambda m: mark("html", "\n" + fenced(strip_tags(m[1])) + "\n"), text)
        text = _CODE.sub(lambda m: mark("html", hold(f"`{strip_tags(m[2])}`")), text)
    if "\\begin" in text:
        text = _VERBATIM.sub(lambda m: mark("latex", fenced(m[2])), text)
    if "`" in text:
        text = _SPAN.sub(lambda m: mark("markdown", hold(f"`{m[2]}`")), text)
    if "\\" in text or "$" in text:
        text = _DISPLAY.sub(lambda m: mark("latex", hold(f"$${(m[1] or m[2] or m[5] or '').strip()}$$")), text)

        def inline(m: re.Match) -> str:
            inner = m[1] or m[2]
            return mark("latex", hold(f"${inner.strip()}$")) if m[1] or _MATHS.search(inner) else m.group()

        text = _INLINE_MATH.sub(inline, text)

    if "<" in text:
        if "<!--" in text:
            text = _HTML_COMMENT.sub(lambda m: mark("html", ""), text)
        text = re.sub(r"(?is)<(script|style)\b[^<>]*>.*?</\1\s*>", lambda m: mark("html", ""), text)

        def tag(m: re.Match) -> str:
            kinds.add("html")
            closing, name = m[1], (m[2] or "").lower()
            if re.fullmatch("h[1-6]", name):
                return "\n\n" if closing else f"\n\n{'#' * int(name[1])} "
            if name == "li":
                return "" if closing else "\n- "
            if name in ("td", "th"):
                return " " if closing else "| "
            if name == "tr":
                return "|\n" if closing else "\n"
            if name == "br":
                return "\n"
            if name == "blockquote":
                return "\n" if closing else "\n> "
            return "\n" if re.fullmatch(f"{_BLOCK_TAGS}|caption|html|head|body|title", name) else ""

        text = _TAG.sub(tag, text)
        text = _AUTO.sub(lambda m: mark("markdown", m[1]), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: mark("html", html.unescape(m.group())) if html.unescape(m.group()) != m.group() else m.group(), text)

    if "{" in text or "[[" in text or "''" in text or "==" in text:
        if "{|" in text:

            def table(m: re.Match) -> str:
                rows = []
                for row in re.split(r"^\|-[^\n]*$", m[1].split("\n", 1)[-1], flags=re.M):
                    cells = [c.strip() for line in row.strip().split("\n") if line[:1] in "|!" and line[1:2] != "+" for c in re.split(r"\|\||!!", line[1:])]
                    if cells:
                        rows.append(f"| {' | '.join(c.split('|')[-1].strip() for c in cells)} |")
                return mark("wiki", hold("\n".join(rows)))

            text = _WIKI_TABLE.sub(table, text)
        n = 1
        while n:
            text, n = _TEMPLATE.subn(lambda m: mark("wiki", ""), text)
        text = _WIKI_HEADING.sub(lambda m: mark("wiki", hold(f"{'#' * len(m[1])} {m[2]}")), text)
        text = re.sub(r"^([ \t]*)[-*+][ \t]+(?=[^\n]*\[\[[^\n]*\]\])", lambda m: mark("markdown", f"{m[1]}- "), text, flags=re.M)
        text = _WIKI_LINK.sub(lambda m: mark("wiki", m[1].strip()), text)
        text = _WIKI_EMPH.sub(lambda m: mark("wiki", m[2]), text)
    if "[" in text:
        text = _WIKI_URL.sub(lambda m: mark("wiki", m[1]), text)

    if "\\" in text:
        levels = {"part": 1, "chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3}
        text = _SECTION.sub(lambda m: mark("latex", hold(f"{'#' * levels.get(m[1], 4)} {m[2]}")), text)
        text = _HREF.sub(lambda m: mark("latex", m[1]), text)
        n = 1
        while n:  # from the inside out, however deep; each step takes signs away
            text, n = _STYLE.subn(lambda m: mark("latex", m[1]), text)
        text = _MENTION.sub(lambda m: mark("latex", ""), text)
        text = _ITEM.sub(lambda m: mark("latex", f"\ue002 {m[1] + ' ' if m[1] else ''}"), text)
        text = _ENVIRONMENT.sub(lambda m: mark("latex", ""), text)
        text = _BREAKS.sub(lambda m: mark("latex", ""), text)

    html_text = "html" in kinds
    if "#" in text:
        found = _ATX.sub(lambda m: hold(f"{m[1]} {m[2]}"), text)
        if found != text and (not html_text or _ATX.search(body)):
            kinds.add("markdown")
        text = found
    text = _SETEXT.sub(lambda m: mark("markdown", hold(f"{'#' if m[2][0] == '=' else '##'} {m[1].strip()}")), text)
    if "|" in text and _TABLE_RULE.search(text):
        kinds.add("markdown")
    if _BULLET.search(body) and _BULLET.search(text):
        kinds.add("markdown") if not html_text or any(m.group() in body for m in _BULLET.finditer(text)) and re.search(r"(?m)^[ \t]*[-*+][ \t]+\S", body) else None
        text = _BULLET.sub(lambda m: f"{m[1]}- ", text)
    if _NUMBERED.search(text) and _NUMBERED.search(body):
        kinds.add("markdown")
    if ">" in body and _QUOTE.search(text) and _QUOTE.search(body):
        kinds.add("markdown")
    text = _RULE.sub(lambda m: mark("markdown", ""), text)
    if "[" in text:
        text = _IMAGE.sub(lambda m: mark("markdown", m[1]), text)
        text = _LINK.sub(lambda m: mark("markdown", m[1]), text)
        names = {m[1].lower() for m in _REF_DEF.finditer(text)}
        if names:
            text = _REF_LINK.sub(lambda m: mark("markdown", m[1]) if (m[2] or m[1]).lower() in names else m.group(), text)
            text = _REF_DEF.sub(lambda m: mark("markdown", ""), text)
    if "*" in text or "_" in text:
        text = _STRONG.sub(lambda m: mark("markdown", m[2] or m[4]), text)
    if "~~" in text:
        text = _STRIKE.sub(lambda m: mark("markdown", m[1]), text)
    if "latex" in kinds:
        text = text.replace("~", " ")

    text = text.replace("\ue002", "-")
    while "\ue000" in text:  # what is held refers to what was held before it only
        text = re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], text)
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\xa0", " "))
    return sorted(kinds), re.sub(r"\n{3,}", "\n\n", text).strip()


# --- repeated substrings ------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")


class Streams:
    """The words of several texts as one array of codes, each text being a slice of it."""

    def __init__(self, texts: list[str]) -> None:
        words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.codes, self.vocabulary = pd.factorize(np.array([*chain.from_iterable(words), ""], dtype=object))
        self.codes = self.codes[:-1].astype(np.int64)

    def hashes(self, length: int, seed: int = 0) -> np.ndarray:
        """The hash of the ``length`` words from each position on; those that run over a text's end mean nothing."""
        each = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary], dtype=np.uint64)
        of = np.concatenate((each[self.codes], np.zeros(length, dtype=np.uint64)))
        n = len(self.codes)
        with np.errstate(over="ignore"):
            total = np.zeros(n, dtype=np.uint64)
            for k in range(length):
                total = total * np.uint64(0x9E3779B97F4A7C15) + of[k : k + n]
            total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
        return total


def repeated_windows(streams: Streams, pages: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the positions at which ``length`` words begin that stand on a lower page too.

    A suffix array by prefix doubling, carried on until suffixes are ranked by their first ``length`` words:
    those of equal rank share them. Texts are separated by codes of their own, so none is overrun.
    """
    count, total = len(streams.sizes), len(streams.codes)
    at = streams.starts[:-1] + np.arange(count)
    flat = np.empty(total + count, dtype=np.int64)
    ends = streams.starts[1:] + np.arange(count)
    inside = np.ones(len(flat), dtype=bool)
    inside[ends] = False
    flat[inside] = streams.codes
    flat[ends] = -1 - np.arange(count)
    owner = np.repeat(pages, streams.sizes + 1)
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < length:
        step = min(reach, length - reach)
        later = np.full(len(rank), -1, dtype=np.int64)
        later[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + later + 1, return_inverse=True)[1].astype(np.int64)
        reach += step
    first = np.full(int(rank.max()) + 1 if len(rank) else 1, np.iinfo(np.int64).max)
    np.minimum.at(first, rank, owner)
    hit = owner > first[rank]
    # A window that runs over its text's end holds the separator and is of one text only.
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(at, streams.sizes)]


def fingerprints(total: np.ndarray, every: int) -> np.ndarray:
    """The positions of hashes that are least among ``every`` neighbours: equal stretches of that many share one."""
    if not len(total):
        return np.zeros(0, dtype=np.int64)
    every = min(every, len(total))
    seen = np.lib.stride_tricks.sliding_window_view(total, every)
    return np.unique(np.arange(len(seen)) + seen.argmin(axis=1))


def _remove(text: str, starts: list[int], length: int) -> str:
    """``text`` without the words of the windows that begin at ``starts``."""
    if not len(starts):
        return text
    words = [m.span() for m in _TOKEN.finditer(text)]
    covered = np.zeros(len(words) + 1, dtype=np.int8)
    for i in starts:
        covered[i : i + length] = 1
    out, at = [], 0
    for (a, b), gone in zip(words, covered):
        if gone:
            out.append(text[at:a])
            at = b
    out.append(text[at:])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", "".join(out))).strip()


def clean(df: DataFrame, item: str, path: str, body: str, length: int = REPEAT_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, kinds, text): the markup found in each body and its clean text without repeated boilerplate.

    A page is a path: the same page under another id repeats nothing, and rows that share path and body come
    out alike. Of a substring of at least ``length`` words on several pages of a host, the copy on the lowest
    page stays, whatever the size of the blocks. Null and empty bodies are left out; a null path is the page of a
    host without a name, to which all such rows belong.
    """
    rows = df.where(F.length(body) > 0).select(F.col(item).cast("long").alias("_k"), F.coalesce(F.col(path), F.lit("")).alias("_p"), F.col(body).alias("_t"))
    rows = rows.withColumn("_host", F.xxhash64(F.substring_index("_p", "/", 1))).withColumn("_page", F.xxhash64("_p"))
    sizes = rows.groupBy("_host").agg(F.ceil(F.sum(F.length("_t")) / block_chars).alias("_blocks"))
    sizes = cut(sizes)
    placed = rows.join(sizes, "_host").withColumn("_block", F.pmod(F.xxhash64("_k"), "_blocks")).drop("_p")
    window = max(1, length // 2)
    every = length - window + 1

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        once = {t: convert(t) for t in set(pdf["_t"])}
        done = [once[t] for t in pdf["_t"]]
        texts = [t for _, t in done]
        hits = repeated_windows(Streams(texts), pdf["_page"].to_numpy(), length)
        return pd.DataFrame({item: pdf["_k"], "_host": pdf["_host"], "_page": pdf["_page"], "_block": pdf["_block"], "kinds": [k for k, _ in done], "text": texts, "_hits": [h.tolist() for h in hits]})

    made = placed.groupBy("_host", "_block").applyInPandas(block, f"{item} long, _host long, _page long, _block long, kinds array<string>, text string, _hits array<int>")
    made = cut(made.withColumn("_row", F.monotonically_increasing_id()))

    # A window without a hit is on the lowest page of its block, so one row or page a block stands for it below, however
    # many pages hold it, and the lowest page of the host is among them.
    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams = Streams(batch["text"].tolist())
            total, parts = streams.hashes(window), []
            for row, host, blk, hits, a, n in zip(batch["_row"], batch["_host"], batch["_block"], batch["_hits"], streams.starts, streams.sizes):
                if n < length:
                    continue
                at = fingerprints(total[a : a + n - window + 1], every)
                if len(hits):
                    gone = np.zeros(n - length + 2, dtype=np.int64)
                    gone[np.asarray(hits) + 1] = 1
                    low, high = np.maximum(0, at - every + 1), np.minimum(at, n - length) + 1
                    counts = np.cumsum(gone)
                    at = at[counts[high] - counts[low] < high - low]
                # The host goes into the hash, so repeats never reach beyond it.
                parts.append((np.full(len(at), row), np.full(len(at), blk), at, (total[a + at] ^ np.uint64(host & (2**64 - 1))).astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * 4
            yield pd.DataFrame(dict(zip(("_row", "_block", "_at", "_f"), columns)))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams = Streams(batch["text"].tolist())
            one, two, out = streams.hashes(length, 1).astype(np.int64), streams.hashes(length, 2).astype(np.int64), []
            for row, host, page, hits, ats, a, n in zip(batch["_row"], batch["_host"], batch["_page"], batch["_hits"], batch["_ats"], streams.starts, streams.sizes):
                near = {j for i in ats for j in range(max(0, i - every + 1), min(i, n - length) + 1)} - set(hits)
                out += [(row, page, host, j, one[a + j], two[a + j]) for j in sorted(near)]
            yield pd.DataFrame(out, columns=["_row", "_page", "_host", "_at", "_f", "_g"])

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts = [[*h, *([] if more is None else more)] for h, more in zip(batch["_hits"], batch["_more"])]
            text = [_remove(t, s, length) for t, s in zip(batch["text"], starts)]
            yield pd.DataFrame({item: batch[item], "kinds": batch["kinds"], "text": text})

    # Sampled prints of fewer words are candidates only: every repeat of ``length`` words shares one with its copies.
    # Hosts of one block are whole already and sample nothing.
    several = made.join(sizes.where("_blocks > 1").select("_host"), "_host", "left_semi")
    marks = cut(several.select("_row", "_host", "_block", "text", "_hits").mapInPandas(prints, "_row long, _block long, _at int, _f long"))
    # min and max combine before the shuffle, so a fingerprint on a third of all pages costs no task more than others.
    shared = marks.groupBy("_f").agg(F.min("_block").alias("_first"), F.max("_block").alias("_last")).where("_first < _last")
    near = marks.join(shared.select("_f"), "_f", "left_semi").groupBy("_row").agg(F.sort_array(F.collect_set("_at")).alias("_ats"))
    # Then every window of ``length`` words around a candidate is compared whole, by two hashes of 64 bits.
    whole = cut(made.select("_row", "_page", "_host", "text", "_hits").join(near, "_row").mapInPandas(windows, "_row long, _page long, _host long, _at int, _f long, _g long"))
    lowest = whole.groupBy("_host", "_f", "_g").agg(F.min("_page").alias("_first"), F.max("_page").alias("_last")).where("_first < _last").drop("_last")
    more = whole.join(lowest, ["_host", "_f", "_g"]).where("_page > _first").groupBy("_row").agg(F.sort_array(F.collect_set("_at")).alias("_more"))
    return made.select("_row", item, "kinds", "text", "_hits").join(more, "_row", "left").mapInPandas(trim, f"{item} long, kinds array<string>, text string")
