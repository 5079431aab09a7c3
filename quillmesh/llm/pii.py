"""Problem 3: personal information in free text, found and replaced by typed placeholders.

A skip-chain conditional random field labels each document's candidate segments (number groups, mail-like,
street-like and name-like token runs). Neighbouring segments form the chain; segments that repeat or share a
rare token are joined by skip edges, and loopy message passing, carried on until no message moves, makes their
labels agree across the document.
The field is trained here, by pseudo-likelihood, on sentences made by the small grammar below. What tells a
person's name from a service's is how often its words and word pairs occur in the distinct texts; that is evidence
with a weight like any other, and a name that copies or its bearer's work make frequent stays a name.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut

KINDS = ("email", "phone", "id_number", "address", "person_name")
LABELS = ("O", *KINDS)
#: Sentences of the grammar on which the field is trained, and the grammar's seed.
TRAINING_TEXTS, SEED = 2500, 7
#: Shares of all documents (and least counts) from which a lower-case word, a capitalised word and a pair of
#: capitalised words are common.
LOWER_SHARE, WORD_SHARE, PAIR_SHARE, LEAST = 2e-4, 5e-3, 1e-4, (3, 25, 5)
#: The most entries of each kind that a lexicon can have. A word counts as common only from the share of all counts
#: that as many words at most can reach, so the bound holds for documents of any length and nothing is cut off.
LEXICON = 200_000
#: Messages are final when none moves by more; a loop that has not settled after so many rounds is damped, and left
#: as it stands after LAST rounds beyond the longest chain.
STILL, DAMPED, LAST = 1e-4, 30, 200
#: Share of a common pair's documents from which words beside it that speak for a person clear it of being common.
PERSON_SHARE = 0.02

# --- candidate segments -------------------------------------------------------------------------------------

_AT = r"(?:[ ]?@[ ]?|[ ]?[\[(]at[\])][ ]?|[ ]at[ ])"
_DOT = r"(?:\.|[ ]dot[ ]|[ ]?[\[(]dot[\])][ ]?)"
_EMAIL = re.compile(rf"(?i)(?<![\w.+%-])[a-z0-9][\w.+%-]*{_AT}[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z][a-z0-9-]*)+(?![\w-])")
_NUMBER = re.compile(r"(?<![\w.+#$-])(?:\+|\(0\)|\()?\d[\d().\-/ ‑–]{3,24}\d(?!\w)(?!\.\d)(?!-[A-Za-z])")
_CODE = re.compile(r"(?<![\w./=+-])(?:[A-Z]{1,5}\d{5,9}[A-Z]{0,3}|[A-Z]{2}(?:[ ]\d\d){3}[ ][A-Z]|[A-Z]{2}\d{6}[A-Z]|\d{5,9}[A-Z])(?![\w/=+-])")
# Words by which streets and dwellings are known.
_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Court|Ct|Boulevard|Blvd|Way|Terrace|Place|Pl|Square|Sq|Crescent|Row|Hill|Gardens|Grove|Mews|Parkway|Highway"
# Capital and small letters of the scripts that have them; Latin letters beyond the first block count as either.
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀ-žΆ-ΏΑ-ΫЀ-Я", "a-zß-öø-ÿĀ-žά-ώа-џ"
_CAP = rf"[{_UP}][\w'’.-]*"
_CITY = rf"[{_UP}][\w'’-]*(?:[ ][{_UP}][\w'’-]*(?=,?[ ]\d{{4,6}}\b))?"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?[ ]\w{{1,5}},[ ])?\b\d{{1,5}}[A-Za-z]?[ ](?:{_CAP}[ ]){{1,3}}(?:{_STREETS})\b\.?(?:,?[ ](?:Flat|Apt|Apartment|Unit|Suite)\.?[ ]\w{{1,5}})?(?:,[ ]{_CITY})?(?:,?[ ]\d{{4,6}}\b)?"
    rf"|\b\d{{1,5}},?[ ](?:bis[ ])?(?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|route)[ ](?:(?:des|du|de la|de l['’]|de|la|les)[ ]?)?{_CITY}(?:,[ ]\d{{4,5}}[ ]{_CITY})?"
    rf"|\b[A-ZÄÖÜ][\wäöüß-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer)[ ]\d{{1,4}}[a-z]?\b(?:,[ ]\d{{4,5}}[ ]{_CITY})?"
    rf"|\b(?:[Cc]alle|[Vv]ia|[Rr]ua|[Aa]venida|[Pp]laza|[Pp]iazza|[Vv]iale|[Cc]orso)[ ]{_CAP}(?:[ ]{_CAP})?,?[ ]\d{{1,4}}\b(?:,[ ]\d{{4,5}}[ ]{_CITY})?"
    rf"|\b\d{{1,4}},?[ ](?:[Cc]alle|[Vv]ia|[Rr]ua|[Aa]venida|[Pp]laza|[Pp]iazza|[Vv]iale|[Cc]orso)[ ]{_CAP}(?:[ ]{_CAP})?(?:,[ ]\d{{4,5}}[ ]{_CITY})?"
    rf"|\b(?:ул\.|улица|пр\.|проспект|пер\.|переулок)[ ]{_CAP}(?:[ ]{_CAP})?,?[ ](?:д(?:ом|\.)?[ ]?)?\d{{1,4}}(?:,?[ ](?:кв|оф)\.?[ ]?\d{{1,4}})?"
    r"|[一-鿿]{2,12}(?:路|街|道|巷|胡同)\d{1,5}[号號](?:\d{1,4}[室栋楼])?|[一-鿿ヶ]{2,12}(?:町|丁目|番地)\d{1,4}(?:[-−]\d{1,4}){0,2}(?:番地|号)?"
)
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Dame|Herr|Frau|Mme|M|Señor|Señora|Sr|Sra)"
_WORD = rf"(?:[{_UP}][{_LOW}'’]+(?:[-'’][{_UP}][{_LOW}]+)*|[{_UP}]{{2,}}(?:[-'’][{_UP}]+)*)"
_INITIAL = rf"[{_UP}]\."
_PARTICLE = r"(?:(?:van|von|de|der|den|del|di|da|la|le|al|bin)[ ]){0,2}"
_NAME = re.compile(
    rf"(?<![\w@/.+=-])(?:(?P<title>{_TITLE})\.?[ ](?:{_INITIAL}[ ]?){{0,2}}{_PARTICLE}(?P<tf>{_WORD})(?:[ ](?P<tl>{_WORD}))?"
    rf"|(?P<initial>(?:{_INITIAL}[ ]?){{1,2}}){_PARTICLE}(?P<if>{_WORD})"
    rf"|(?P<last>{_WORD}),[ ](?P<first>{_WORD}|{_INITIAL})(?:[ ]{_INITIAL})?"
    rf"|(?P<one>{_WORD})[ ](?:{_INITIAL}[ ]){{0,2}}{_PARTICLE}(?P<two>{_WORD}))(?![\w@/=+%-])"
)
# Frequent Chinese family names, and words beside a Chinese or Japanese name.
_WIDE_FAMILIES = "王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧程曹袁邓鄧许許傅沈曾彭吕呂苏蘇卢盧蒋蔡贾丁魏薛叶葉阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_WIDE_AFTER = "先生|女士|小姐|老师|教授|经理|工程师|医生|同志|さん|様|さま|氏|君|部長|課長"
_WIDE_NAME = re.compile(
    rf"(?:(?P<cue>(?:姓名|联系人|经办人|负责人|担当|氏名)[:：]?[ ]?)|(?<!\w))(?P<wide>[{_WIDE_FAMILIES}][一-鿿]{{1,2}}?)(?:(?P<after>{_WIDE_AFTER})|(?!\w))"
)
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_JOINED = re.compile(r"\S*[@/\\_+]\S*|\S+\.\w\S*|\S+(?=[ ]?(?:@|[\[(]at[\])]|at \S+ dot ))")
_PAIR = re.compile(rf"(?<![\w@/])({_WORD}),?[ ](?=({_WORD})\b)")

# Words near a number that tell what it is.
_CUES = {
    "id": "ssn social security passport licence license driving personnummer national insurance nino identity id card tax tin vat taxpayer cpf dni nie nif fiscal steuer personal citizen resident",
    "phone": "call text phone tel telephone mobile cell fax voicemail reach reached dial ring whatsapp sms contact",
    "other": "row build ticket epoch counter part version port bytes rows files ran order invoice issue pr line page commit release builds number lane rack step id.",
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws.split()}
# Words beside a name that speak for a person; services take part in all other sentences as well.
_BESIDE = (re.compile(r"(?i)\b(?:signed(?:[ ]off)?[ ]by|agreed[ ]with|ask|asked|told|thanks[ ]to|dear|regards,)[ (]*$"), re.compile(r"(?i)[ ](?:asked|told|said|wrote|thinks|signed|agreed|phoned)\b"))
_UNITS = set("bytes rows files builds lines".split())
_CUE["number"] = "numberword"
_CUE["no"] = "numberword"
_NOT_NAMES = set(f"{_STREETS}|Flat|Apt|Apartment|Unit|Suite|Room|The|A|An|I|It|We|He|She|They|You|This|That|These|Those|In|On|At|By|For|From|To|With|And|Or|Not|No|Yes|If|When|Per|Ask|See|Via|Re|Please|Do|Use|Our|Two|Only|Both|Keep|Call|Text|Send|Copy|My|Your|Their|His|Her|SSN|Box|PO|Unter|Über|Auf|Bei|Nach|Von|Am|Im|Zum|Zur".split("|"))


@dataclass
class Segment:
    start: int
    end: int
    shape: str
    text: str
    features: list[str] = field(default_factory=list)
    keys: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Lexicon:
    """What is common in all documents: lower-case words, capitalised words, pairs of capitalised words."""

    lower: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()
    pairs: frozenset[str] = frozenset()


def _context(text: str, start: int, end: int) -> list[str]:
    line = text.rfind("\n", 0, start)
    stop = text.rfind(". ", line + 1, start)
    while stop > line and re.search(r"\b(?:no|nr|num|tel|[A-Za-z])$", text[max(line + 1, stop - 4) : stop], re.I):
        stop = text.rfind(". ", line + 1, stop)
    line = max(line, stop)
    before = [w.lower() for w in re.findall(r"[\w.]+", text[max(line + 1, start - 64) : start])][-6:]
    after = [w.lower() for w in re.findall(r"\w+", text[end : end + 32].split("\n")[0])][:3]
    cues = [_CUE[w.strip(".")] for w in before if w.strip(".") in _CUE and w.strip(".") not in _UNITS]
    cues = [c for c in cues if c != "numberword"][-1:] or cues[-1:]  # the nearest tells most
    out = [f"before:{c}" for c in cues]
    return sorted(set(out)) + sorted({f"after:{_CUE[w]}" for w in after if w in _CUE})


def _beside_person(text: str, start: int, end: int) -> bool:
    return bool(_BESIDE[0].search(text[max(0, start - 24) : start]) or _BESIDE[1].match(text, end))


def _name(m: re.Match, lexicon: Lexicon) -> tuple[list[str], frozenset[str]]:
    g = m.groupdict()
    form = "title" if g["title"] else "initial" if g["initial"] else "reversed" if g["last"] else "plain"
    parts = [w for w in (g["tf"], g["tl"], g["if"], g["last"], g["first"], g["one"], g["two"]) if w and not w.endswith(".")]
    if g["tl"] and (g["tl"].lower() in lexicon.lower or g["tl"] in _NOT_NAMES):
        parts.remove(g["tl"])
        g["tl"] = None
    family = g["tl"] or g["tf"] or g["if"] or g["last"] or g["two"]
    pair = " ".join(w.casefold() for w in parts) if len(parts) > 1 else ""
    known = [w for w in parts if w.lower() in lexicon.lower or w.capitalize() in _NOT_NAMES or w in _NOT_NAMES]
    common = [w for w in parts if w.casefold() in lexicon.words]
    out = [f"form:{form}", f"form:{form}:lower:{len(known)}", f"form:{form}:common:{len(common)}"]
    if family.lower() in lexicon.lower or family.capitalize() in _NOT_NAMES:
        out.append("family:lower")
    if family.casefold() in lexicon.words:
        out.append("family:common")
    beside = "none"
    if _beside_person(m.string, m.start(), m.end()):
        beside = "person"
    elif all(p.isupper() for p in parts) and re.search(r"\b[A-ZÀ-ÖØ-Þ]+[ ]$", m.string[max(0, m.start() - 24) : m.start()]):
        beside = "capitals"
    if beside == "person":
        out.append("beside:person")
    if pair in lexicon.pairs:
        extent = "all" if len(common) == len(parts) else "part"
        out += ["pair:common", f"pair:common:{extent}", f"pair:common:{extent}:{beside}"]
    if family.isupper() and len(parts) > 1 and not all(p.isupper() for p in parts):
        out.append("case:mixed")
    if len(family) < 3:
        out.append("family:short")
    return out, frozenset([family.casefold()])


def segments(text: str, lexicon: Lexicon) -> list[Segment]:
    """The candidates of a text in order, none inside another that was found before it."""
    found: list[Segment] = []
    taken: list[tuple[int, int]] = []  # disjoint and in order

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (a, a))
        return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b)

    def take(segment: Segment) -> None:
        found.append(segment)
        insort(taken, (segment.start, segment.end))

    if "@" in text or " at " in text or "(at)" in text.lower() or "[at]" in text.lower():
        for m in _EMAIL.finditer(text):
            before, after, value = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 2], m.group()
            out = ["shape:email"]
            if re.search(r"\w+://[^\s]*$", before):
                out.append("email:url")
            if after[:1] in (":", "/") and after[1:2].strip():
                out.append("email:path")
            if before[-1:] in ("@", "/", ":") and before[-1:]:
                out.append("email:joined")
            if " at " in value.lower() and " dot " not in value.lower() and "dot" not in value.lower():
                out.append("email:words")
            take(Segment(m.start(), m.end(), "email", value, out, frozenset([re.sub(_AT, "@", value.lower())])))
    if re.search(r"\d", text):
        for m in _ADDRESS.finditer(text):
            if free(m.start(), m.end()):
                take(Segment(m.start(), m.end(), "address", m.group(), ["shape:address", *_context(text, m.start(), m.end())[:1]], frozenset([m.group().lower()])))
        for pattern, shape in ((_CODE, "code"), (_NUMBER, "number")):
            for m in pattern.finditer(text):
                value = m.group().rstrip(" (.-/")
                a, b = m.start(), m.start() + len(value)
                if value[0] == "(" and ")" not in value:
                    a, value = a + 1, value[1:]
                digits = sum(c.isdigit() for c in value)
                if digits < 5 + (shape == "number") or not free(a, b):
                    continue
                form = re.sub(r"\d+", lambda d: str(len(d.group())), re.sub("[A-Z]+", lambda d: "A" * min(2, len(d.group())), value)).replace("‑", "-").replace("–", "-")
                out = [f"shape:{shape}", f"digits:{min(digits, 13)}", f"form:{form}", f"plus:{value[0] == '+'}", f"groups:{min(5, len(re.findall(r'[A-Z0-9]+', value)))}", *_context(text, a, b)]
                cues = {o for o in out if o.startswith("before:")}
                out.append("cue:" + ("id" if "before:id" in cues else "phone" if "before:phone" in cues else "other" if "before:other" in cues else "none"))
                out.append(f"{out[-1]}:{shape}:{form}")
                if re.search(r"(?:\d{1,3}\.){3}\d", value) or re.match(r"[:.]\d", text[b : b + 2]):
                    out.append("number:address of a host")
                if re.match(r"(?:19|20)\d\d-\d\d\b", value):
                    out.append("number:date")
                take(Segment(a, b, shape, value, out, frozenset([re.sub(r"\D", "", value)])))
    for m in _NAME.finditer(text):
        span = m.span()
        if m["if"] == "Box" or "-----" in text[text.rfind("\n", 0, span[0]) + 1 : span[0]]:
            continue
        if m.group("tl") and (m.group("tl").lower() in lexicon.lower or m.group("tl") in _NOT_NAMES):
            span = (span[0], m.end("tf"))
        while span:
            if free(*span):
                out, keys = _name(m, lexicon)
                take(Segment(*span, "name", text[span[0] : span[1]], ["shape:name", *out], keys))
            # A run of capitalised words is read again from its second word: any pair in it may be the name.
            step = m.end("title") if m.group("title") else (m.end("one") if m.group("one") else m.end("last") if m.group("last") else m.end("initial") if m.group("initial") else m.end())
            again = _NAME.match(text, _skip(text, step)) if step < m.end() else None
            if not again:
                break
            m, span = again, again.span()
            if found and found[-1].shape == "name" and found[-1].end > span[0]:
                if _plausible_name(found[-1]):
                    break
                gone = found.pop()
                del taken[bisect_left(taken, (gone.start, gone.end))]
    if not text.isascii():
        for m in _WIDE_NAME.finditer(text):
            # Two characters alone are too often a word.
            if (m["after"] or m["cue"] or len(m["wide"]) > 2) and free(*m.span("wide")):
                beside = "title" if m["after"] else "cue" if m["cue"] else "none"
                take(Segment(*m.span("wide"), "name", m["wide"], ["shape:name", "form:wide", f"form:wide:{beside}"], frozenset([m["wide"]])))
    found.sort(key=lambda s: s.start)
    return found


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in " ,.":
        at += 1
    return at


def _plausible_name(s: Segment) -> bool:
    return not {"family:lower", "pair:common:all"} & set(s.features) and not any(f.endswith(("lower:1", "lower:2")) for f in s.features)


# --- the field ----------------------------------------------------------------------------------------------


def edges(segs: list[Segment]) -> list[tuple[int, int, str]]:
    """Chain edges between neighbours and skip edges between segments that share a key.

    Skip edges run from each occurrence to the next one with the same key, so they grow with the segments.
    """
    out = [(i, i + 1, "chain") for i in range(len(segs) - 1)]
    last: dict[tuple[str, str], int] = {}
    for i, s in enumerate(segs):
        for k in s.keys:
            if (s.shape, k) in last:
                out.append((last[s.shape, k], i, "skip"))
            last[s.shape, k] = i
    return out


class Field:
    """Weights of a conditional random field over segments, trained by pseudo-likelihood."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.pair = {"chain": np.zeros((len(LABELS), len(LABELS))), "skip": np.zeros((len(LABELS), len(LABELS)))}

    def fit(self, docs: list[tuple[list[Segment], list[int]]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> "Field":
        for segs, _ in docs:
            for s in segs:
                for f in s.features:
                    self.index.setdefault(f, len(self.index))
        n, k, width = sum(len(s) for s, _ in docs), len(LABELS), len(self.index)
        x, y = np.zeros((n, width + 2 * k)), np.zeros(n, dtype=int)
        at = 0
        for segs, gold in docs:
            for i, s in enumerate(segs):
                y[at + i] = gold[i]
                for f in s.features:
                    x[at + i, self.index[f]] = 1
            for i, j, kind in edges(segs):
                base = width + (k if kind == "skip" else 0)
                x[at + i, base + gold[j]] += 1
                x[at + j, base + gold[i]] += 1
            at += len(segs)
        w, speed = np.zeros((width + 2 * k, k)), np.zeros((width + 2 * k, k))
        target = np.eye(k)[y]
        for _ in range(rounds):
            score = x @ w
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - rate * (x.T @ (p - target) / n + decay * w)
            w = w + speed
        self.weights = w[:width]
        for kind, base in (("chain", width), ("skip", width + k)):
            both = w[base : base + k]
            self.pair[kind] = (both + both.T) / 2
        return self

    def label_all(self, docs: list[list[Segment]]) -> list[list[int]]:
        """Labels of the greatest marginals of each document, after loopy message passing until nothing moves.

        All messages of all documents are passed at once, as arrays; a document whose messages rest takes no
        further part. Where there are no skip edges the result is exact.
        """
        k = len(LABELS)
        segs = [s for d in docs for s in d]
        if not segs:
            return [[] for _ in docs]
        at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        # One more row of weights, of zeros, for features that training did not see.
        weights = np.vstack([self.weights, np.zeros((1, k))])
        flat = np.array([self.index.get(f, -1) for s in segs for f in s.features], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum([len(s.features) for s in segs])[:-1]))
        unary = np.add.reduceat(weights[flat], starts, axis=0)
        links = [(at[n] + i, at[n] + j, kind == "skip", n) for n, d in enumerate(docs) for i, j, kind in edges(d)]
        belief = unary.copy()
        if links:
            i, j, skip, owner = (np.array(c, dtype=np.int64) for c in zip(*links))
            source, target, kind, owner = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((skip, skip)), np.concatenate((owner, owner))
            half = len(links)
            back = np.concatenate((np.arange(half) + half, np.arange(half)))
            pair = np.stack([self.pair["chain"], self.pair["skip"]])
            messages = np.zeros((2 * half, k))
            active = np.arange(2 * half)
            for n in range(LAST + max(len(d) for d in docs)):
                told = (belief[source[active]] - messages[back[active]])[:, :, None] + pair[kind[active]]
                top = told.max(axis=1, keepdims=True)
                new = np.log(np.exp(told - top).sum(axis=1)) + top[:, 0, :]
                new -= new.max(axis=1, keepdims=True)
                if n >= DAMPED:
                    new = (new + messages[active]) / 2
                moved = np.abs(new - messages[active]).max(axis=1)
                np.add.at(belief, target[active], new - messages[active])
                messages[active] = new
                restless = np.zeros(len(docs), dtype=bool)
                restless[owner[active[moved > STILL]]] = True
                active = active[restless[owner[active]]]
                if not len(active):
                    break
        best = belief.argmax(axis=1)
        return [best[a:b].tolist() for a, b in zip(at, at[1:])]

    def label(self, segs: list[Segment]) -> list[int]:
        return self.label_all([segs])[0]


# --- training sentences -------------------------------------------------------------------------------------

_FIRSTS = "Anna Boris Chiara Dmitri Elena Farid Greta Hugo Ines Jonas Kaito Lena Mateo Nora Omar Petra Quim Rosa Sven Tara Ugo Vera Wim Yara Zoe".split()
_FAMILIES = "Abernethy Bellweather Castellan Dunmore Eckhart Farnsworth Gallagher Hofmann Ibsen Jablonski Kowalczyk Lindqvist Marchetti Novak Oyelaran Petrov Quiller Rasmussen Sørensen Thackeray Ullmann Villeneuve Whitcombe Yamamoto Zielinski".split()
#: Recurring phrases in capitals, frequent as pairs.
_PHRASES = ["REGRA GERAL", "GRANDE PAUSE", "ZONA LIBRE", "OBRA FINAL"]
#: Persons that the training lexicon takes for as frequent as a service, with their words and as a pair.
_FREQUENT = [("Greta", "Gallagher"), ("Omar", "Novak"), ("Lena", "Petrov")]
_SERVICES = ["Silver Falcon", "Iron Valley", "Quiet Harvest", "Granite", "Nimbus", "Willow", "Emerald Coast", "Sierra", "Amber Lagoon", "CLEAR MEADOW"]
_PHONES = ("+1 (555) 01{2}-{4}", "+1.202.555.{4}", "202 555 {4}", "555-{4}", "(0)161 496 {4}", "020 7946 {4}", "+44 7700 900{3}", "+447700900{3}", "+33 1 {2} {2} {2} {2}", "+49 30 {5} {3}", "(202) 555-{4}", "+46 8 {3} {2} {2}", "0{3}-{7}", "202-555-{4}", "+351 {3} {3} {3}")
_IDS = ("{3} {2} {4}", "{3}-{2}-{4}", "{9}", "{6}-{4}", "QQ {2} {2} {2} C", "X{7}", "RC{6}F", "KLMNP{6}QR", "{8}T", "{8}-{4}", "{3}.{3}.{3}-{2}", "P{8}")
_NUMBERS = ("{3}-{2}-{3}", "{4}-{2}-{4}", "{9}", "{10}", "{1}.{3}.{4}", "{3} {3}", "2026-{2}-{4}", "192.0.2.{3}", "{8}", "{3} {3} {3}", "{7}", "{6}-{4}")


def _fill(pattern: str, rng: random.Random) -> str:
    return re.sub(r"\{(\d)\}", lambda m: "".join(rng.choice("0123456789") for _ in range(int(m[1]))), pattern)


def training_texts(n: int = TRAINING_TEXTS, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) made by the grammar: cases and what looks like them, in varied sentences."""
    rng = random.Random(seed)

    def name() -> str:
        a, b, c = rng.choice(_FIRSTS), rng.choice(_FAMILIES), rng.choice("ABCDEFGHJKLMNPRST")
        if rng.random() < 0.06:
            a, b = rng.choice(_FREQUENT)
        out = rng.choice((f"{a} {b}", f"{a} {b}", f"{a} {c}. {b}", f"{c}. {b}", f"{b}, {a}", f"{rng.choice(('Mr', 'Mrs', 'Ms.', 'Dr.', 'Prof.'))} {b}"))
        return out.upper() if rng.random() < 0.08 and "." not in out else out

    def mail() -> str:
        user = rng.choice((f"{rng.choice(_FIRSTS)}.{rng.choice(_FAMILIES)}".lower(), f"{rng.choice(_FAMILIES).lower()}_{rng.randint(1, 99)}", f"{rng.choice(_FIRSTS).lower()}+list"))
        host = rng.choice(("example.com", "mail.example", "inbox.invalid", "post.test"))
        return rng.choice((f"{user}@{host}",) * 4 + (f"{user} @ {host}", f"{user}(at){host}", f"{user} [at] {host}", f"{user} at {host.replace('.', ' dot ')}"))

    def street() -> str:
        s, t = rng.choice(("Elm", "Harbour", "Chapel", "Station", "Orchard")), rng.choice(("Aldham", "Bexford", "Corley"))
        return rng.choice((f"{rng.randint(1, 200)} {s} {rng.choice(('Street', 'Lane', 'Road', 'Avenue', 'Close'))}, {t} {rng.randint(10000, 99999)}", f"Flat {rng.randint(1, 30)}A, {rng.randint(1, 90)} {s} Rd, {t}", f"{rng.randint(1, 90)} rue des {s}s, {rng.randint(10000, 99999)} {t}", f"{s}weg {rng.randint(1, 90)}, {rng.randint(10000, 99999)} {t}", f"{rng.randint(100, 9000)} {s} Blvd. Apt {rng.randint(1, 60)}, {t}"))

    def case(kind: str) -> tuple[str, str, str]:
        if kind == "person_name":
            return rng.choice(("signed off by ", "Spoke with ", "", "Per ", "see ", "(")), name(), rng.choice((" about it.", ".", ")", " asked us to wait.", ", the rule stays."))
        if kind == "email":
            return rng.choice(("contact: ", "Send it to ", "", "Copy ", "(")), mail(), rng.choice((" next time.", ".", "", ")"))
        if kind == "phone":
            return rng.choice(("Call ", "mobile ", "Text ", "They can be reached on ", "Left a voicemail at ", "", "", "(", "ask ", "see ")), _fill(rng.choice(_PHONES), rng), rng.choice((" after lunch.", ".", " if it stays down.", ")", ""))
        if kind == "address":
            return rng.choice(("They moved to ", "The meter is at ", "", "(", "Home address: ")), street(), rng.choice((" in spring.", ".", ")", ", second floor."))
        return rng.choice(("SSN ", "social security number: ", "Passport no. ", "ID card ", "Their tax number is ", "Driving licence ", "national insurance ", "The applicant gave personnummer ", "tax id ")), _fill(rng.choice(_IDS), rng), rng.choice((".", " is on file.", " by mistake.", "", " belongs to them."))

    def decoy() -> str:
        s, n = rng.choice(_SERVICES), _fill(rng.choice(_NUMBERS), rng)
        return rng.choice((f"Row {n} is a part number.", f"Ticket {n} tracks this.", f"Build {n} took {_fill('{3} {3}', rng)} bytes.", f"The counter went from {_fill('{9}', rng)} to {_fill('{10}', rng)}.", f"Epoch {_fill('{10}', rng)} is the start.", f"It listens on 192.0.2.{rng.randint(1, 250)}:{rng.randint(1000, 9000)}.", f"Spoke with {s} about it.", f"{s} and {rng.choice(_SERVICES)} share one rule.", f"Per {s}, the rule stays.", f"Clone it from git@code.example:{rng.choice(('a', 'b'))}/tool.git first.", f"Use postgres://reader@db.internal.example/main for checks.", f"mobile builds: {rng.randint(100, 900)} of {rng.randint(1000, 9000)}", f"It ran {rng.randint(1, 90)} {s} jobs.", f"{rng.choice(('The', 'Die', 'Our', 'Only', 'Das', 'Le'))} {rng.choice(('Fähre', 'Harbour', 'Station', 'Bericht', 'Granite', 'Relais'))} holds two files.", f"{rng.choice(('Only', 'Both', 'Per', 'The'))} {s} may wait.", f"The {_fill(rng.choice(('{7}', '{8}', '{9}', 'X{7}', '{6}')), rng)} entry holds.", f"{rng.choice('AEO')} {rng.choice(_PHRASES)} holds two files.", f"READ ONLY since {rng.randint(2, 90)} days.", f"{s} holds two files.", f"Version {n} of {s}.", f"Invoice {n} for {s}.", f"Commit {n} by {s}."))

    out = []
    for _ in range(n):
        text, spans = "", []
        again: list[str] = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.4:
                text += decoy() + rng.choice((" ", "\n"))
                continue
            kind = rng.choice(KINDS)
            before, value, after = case(kind)
            text += before.upper() if value.isupper() and rng.random() < 0.3 else before
            spans.append((len(text), len(text) + len(value), kind))
            text += value + after + rng.choice((" ", "\n", "\n\n"))
            if rng.random() < 0.15:
                again.append(value)
                text += "again "
                spans.append((len(text), len(text) + len(value), kind))
                text += value + ".\n"
        out.append((text, spans))
    return out


def _training_lexicon() -> Lexicon:
    lower = {w for t, _ in training_texts(300) for w in re.findall(r"(?<![\w@.+])[a-z]{2,}(?![\w@.+])", t)}
    words = {w.casefold() for s in _SERVICES for w in s.split()} | {w.casefold() for n in _FREQUENT for w in n} | {w.casefold() for w in _FIRSTS[::5] + _FAMILIES[::6]}
    # Persons are seen with every mark of frequency: the pair alone, the words alone, and both.
    pairs = {s.casefold() for s in _SERVICES + _PHRASES if " " in s}
    named = [(a, b) for i, a in enumerate(_FIRSTS) for j, b in enumerate(_FAMILIES) if (i + j) % 5 == 0] + _FREQUENT
    pairs |= {f"{a} {b}".casefold() for n in named for a, b in (n, n[::-1])}
    return Lexicon(frozenset(lower | set("read only since the die our only das le both per spoke call text use commit version invoice row build ticket clone copy".split())), frozenset(words), frozenset(pairs))


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field trained on the grammar's sentences; the same on every run."""
    lexicon, docs = _training_lexicon(), []
    for text, spans in training_texts():
        segs = segments(text, lexicon)
        gold = [next((LABELS.index(k) for a, b, k in spans if a < s.end and s.start < b and (k == "person_name") == (s.shape == "name") and (k != "person_name" or (s.start >= a - 1 and s.end <= b + 1))), 0) for s in segs]
        if segs:
            docs.append((segs, gold))
    return Field().fit(docs)


# --- documents ----------------------------------------------------------------------------------------------


def find_all(texts: list[str], lexicon: Lexicon, model: Field | None = None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal information in each text."""
    docs = [segments(t, lexicon) for t in texts]
    return [_named(segs, labels) for segs, labels in zip(docs, (model or trained()).label_all(docs))]


def find(text: str, lexicon: Lexicon, model: Field | None = None) -> list[tuple[int, int, str]]:
    return find_all([text], lexicon, model)[0]


def _named(segs: list[Segment], labels: list[int]) -> list[tuple[int, int, str]]:
    return [(s.start, s.end, LABELS[l]) for s, l in zip(segs, labels) if l and (s.shape in ("number", "code") or {"email": "email", "address": "address", "name": "person_name"}[s.shape] == LABELS[l])]


def replace(text: str, lexicon: Lexicon, model: Field | None = None) -> str:
    """``text`` with each piece of personal information replaced by ``[KIND]``."""
    return _replaced(text, find(text, lexicon, model))


def _replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """(text): every text once, however often it was copied or delivered; combined before the shuffle."""
    return df.where(F.length(text) > 0).select(text).distinct()


def lexicon_of(texts: DataFrame, text: str) -> Lexicon:
    """What is common over all documents of ``texts``: document counts per word, combined before the shuffle.

    Every row counts, so rows that may repeat a text go through ``distinct_texts`` first. Only what is common reaches
    the driver, at most LEXICON entries of each kind: each has that share of the kind's counts or more.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = defaultdict(int)
        for batch in batches:
            for t in batch["_t"]:
                keys = set()
                t = _JOINED.sub(" ", t)
                for w in _PLAIN.findall(t):
                    if w.islower():
                        keys.add("l" + w)
                    elif w[0].isupper():
                        keys.add("w" + w.casefold())
                for m in _PAIR.finditer(t):
                    keys.add(f"p{m[1]} {m[2]}".casefold())
                    if _beside_person(t, m.start(), m.end(2)):
                        keys.add(f"q{m[1]} {m[2]}".casefold())
                for k in keys:
                    seen[k] += 1
            if len(seen) > 200_000:
                yield pd.DataFrame({"k": list(seen), "n": list(seen.values())})
                seen.clear()
            yield pd.DataFrame({"k": ["#"], "n": [len(batch)]})
        yield pd.DataFrame({"k": list(seen), "n": list(seen.values())})

    rows = texts.where(F.length(text) > 0).select(F.col(text).alias("_t"))
    counts = cut(rows.mapInPandas(count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")))
    mass = {r["mark"]: r["n"] for r in counts.groupBy(F.left("k", F.lit(1)).alias("mark")).agg(F.sum("n").alias("n")).collect()}
    total = mass.get("#", 0)
    got: dict[str, set[str]] = {}
    for mark, share, least in zip("lwp", (LOWER_SHARE, WORD_SHARE, PAIR_SHARE), LEAST):
        kept = counts.where(F.col("k").startswith(mark) & (F.col("n") >= max(least, share * total, mass.get(mark, 0) / LEXICON))).select(F.expr("substr(k, 2)").alias("k"), "n")
        if mark == "p":
            persons = counts.where("startswith(k, 'q')").select(F.expr("substr(k, 2)").alias("k"), F.col("n").alias("_beside"))
            kept = kept.join(persons, "k", "left").where(F.coalesce("_beside", F.lit(0)) < PERSON_SHARE * F.col("n"))
        got[mark] = {r["k"] for r in kept.collect()}
    return Lexicon(frozenset(got["l"]), frozenset(got["w"]), frozenset(got["p"]))


def kinds_found(df: DataFrame, keys: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """(*keys, kind): each kind of personal information that occurs in each row's text, once."""
    model = trained()
    sent = df.sparkSession.sparkContext.broadcast((lexicon, model))
    fields = [f.name + " " + f.dataType.simpleString() for f in df.select(*keys).schema]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, model = sent.value
        for batch in batches:
            found = find_all(batch["_t"].tolist(), lexicon, model)
            rows = [(*key, kind) for key, spans in zip(batch[keys].itertuples(index=False, name=None), found) for kind in sorted({k for _, _, k in spans})]
            yield pd.DataFrame(rows, columns=[*keys, "kind"])

    return df.where(F.length(text) > 0).select(*keys, F.col(text).alias("_t")).mapInPandas(work, f"{', '.join(fields)}, kind string")


def replaced(df: DataFrame, keys: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """(*keys, text): every row's text with typed placeholders; null and empty texts stay as they are."""
    sent = df.sparkSession.sparkContext.broadcast((lexicon, trained()))
    fields = [f.name + " " + f.dataType.simpleString() for f in df.select(*keys).schema]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, model = sent.value
        for batch in batches:
            found = find_all([t or "" for t in batch["_t"]], lexicon, model)
            yield batch.assign(text=[_replaced(t, spans) if spans else t for t, spans in zip(batch["_t"], found)])[[*keys, "text"]]

    return df.select(*keys, F.col(text).alias("_t")).mapInPandas(work, f"{', '.join(fields)}, text string")
