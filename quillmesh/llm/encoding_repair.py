"""Problem 10: text that came out of a wrong decoding.

Round-trip repair: a stretch is re-encoded under a legacy encoding that can have been used by mistake and
strictly decoded as the encoding that can have been meant; the result is kept when its garbling cost is
lower, and the step is repeated for nested layers, however many, until none lowers the cost. Texts without a
non-ASCII character never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings by which UTF-8 is often read by mistake, most frequent first.
READ_AS = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp850", "cp866", "iso8859-2", "iso8859-5", "cp1253", "cp1254", "iso8859-15")
#: The same for multi-byte encodings, where a stray byte may be lost at either end.
READ_AS_WIDE = ("gb18030", "cp932", "big5", "euc_kr")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
WIDE = ("cp932", "gb18030", "euc_jp", "big5")
# Share of each letter in Russian text, in per mille.
RUSSIAN = dict(
    о=110, е=85, а=80, и=74, н=67, т=63, с=55, р=47, в=45, л=44, к=35, м=32, д=30, п=28, у=26, я=20, ы=19,
    ь=17, г=17, з=17, б=16, ч=14, й=12, х=10, ж=9, ш=7, ю=6, ц=5, щ=4, э=3, ф=3, ъ=0.4, ё=2,
)
#: Characters up to which what became of a stretch is remembered; 64 times the entries bound the memory.
REMEMBERED = 64

_RUN = re.compile(r"[^\x00-\x7f]+")
_C1 = re.compile(r"[\x80-\x9f]")
_LOST = re.compile("[�-]")
_UTF8_IN_LATIN = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe2[\x80-\xbf]{2})+")
_HIGH_LATIN_WORDS = re.compile(r"[\xa8\xb8\xc0-\xff][\xa1-\xff]*(?:[ ,;:.!?()\-]+[\xa8\xb8\xc0-\xff][\xa1-\xff]*)*")
_CYRILLIC_WORDS = re.compile(r"[Ѐ-ӿ]+(?:[ ,;:.!?()\-]+[Ѐ-ӿ]+)*")
_CAPITAL_WORDS = re.compile(r"[Ѐ-ӿ]?[Ђ-Џ\u0410-Я]+(?:[ ,;:.!?()\-]+[Ѐ-ӿ]?[Ђ-Џ\u0410-Я]+)*")
_CP1252_STRETCH = re.compile("[\x20-\x7e\x80-\xffŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™]{4,}")

# Accented letters that one language writes; a run of such letters is no double-byte text.
_ALPHABETS = [frozenset(a + a.upper()) for a in ("äöüßéàç", "àâäæçéèêëîïôöœùûüÿ", "áéíóúüñçàèìòùïª", "áâãàçéêíóôõúüªº", "åäöæøéüô", "áéíóúýþæöð", "àèéìíîòóùúªº", "áčďéěíňóřšťúůýžäôľĺŕ")]
#: Non-ASCII characters with the single ASCII trail bytes that a double-byte encoding allows between them.
_DOUBLE_RUN = re.compile(r"[^\x00-\x7f](?:[\x40-\x7e]?[^\x00-\x7f]){2,}[\x40-\x7e]?")


def _sloppy(text: str, encoding: str) -> bytes | None:
    """``text`` in ``encoding``; code points 80-9F stand for themselves, as readers of cp1252 leave them."""
    try:
        return text.encode(encoding)
    except UnicodeError:
        pass
    if encoding != "cp1252":
        return None
    out = bytearray()
    for ch in text:
        if 0x80 <= ord(ch) <= 0x9F:
            out.append(ord(ch))
        else:
            try:
                out += ch.encode("cp1252")
            except UnicodeError:
                return None
    return bytes(out)


@lru_cache(maxsize=65536)
def _kind(ch: str) -> str:
    """Rough class of a character: a script for letters, else the part it plays."""
    o = ord(ch)
    if o < 0x80:
        return "ascii" if ch.isalpha() else "plain"
    if 0x80 <= o <= 0x9F or ch == "�" or 0xE000 <= o <= 0xF8FF:
        return "broken"
    category = unicodedata.category(ch)
    if category in ("Cn", "Cs"):
        return "broken"
    if category[0] in "LM":
        if o <= 0x17F:
            return "latin"
        if 0x410 <= o <= 0x44F or ch in "Ёё":
            return "russian"
        if 0x400 <= o <= 0x4FF:
            return "cyrillic"
        if 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0xAC00 <= o <= 0xD7AF:
            return "wide"
        if 0x370 <= o <= 0x3FF:
            return "greek"
        return "odd"
    if 0x2500 <= o <= 0x259F:
        return "box"
    if o in (0xA0, 0x3000):
        return "space"
    if 0x2010 <= o <= 0x203A or 0x3001 <= o <= 0x303F or 0xFF00 <= o <= 0xFFEF or ch in "«»¡¿°§…€±×·":
        return "mark"
    if category in ("So", "Sm", "Sc", "Sk", "No", "Po", "Pi", "Pf", "Ps", "Pe", "Lm"):
        return "sign"
    return "odd"


def cost(text: str, before: str = "", after: str = "") -> float:
    """How garbled ``text`` looks between its neighbouring characters; 0 for text that reads well."""
    total, line = 0.0, f"{before}{text}{after}"
    kinds = [_kind(c) for c in line]
    letters = {"ascii", "latin", "russian", "cyrillic", "greek", "wide", "odd"}
    for i, k in enumerate(kinds):
        if k == "broken":
            total += 4
        elif k == "odd":
            total += 3
        elif k in ("cyrillic", "greek"):
            total += 1
        if not i:
            continue
        p, pair = kinds[i - 1], {kinds[i - 1], k}
        if p == k == "box" and (line[i - 1] < "▀") != (line[i] < "▀"):
            total += 1
        if k in letters and p in letters and p != k:
            total += 0 if pair == {"ascii", "latin"} else 0.2 if "wide" in pair else 1 if pair == {"russian", "cyrillic"} else 2
        elif p == k == "latin":
            total += 0.8
        elif p in letters and line[i] in "±°§¦©¬®‚„":
            total += 1
        elif "sign" in pair and pair <= {"sign", "mark"} and line[i] != line[i - 1]:
            total += 0.3
        elif "sign" in pair and pair & letters or ("box" in pair and pair & (letters | {"sign", "mark"})):
            total += 1.5
        elif pair & {"mark", "space"} and "latin" in pair and line[i - 1] + line[i] and line[i if k == "latin" else i - 1] in "ÂÃâÅÄÐÑÎÏ":
            total += 1
        if k in ("latin", "russian") and p in letters and line[i].isupper() and line[i - 1].islower():
            total += 1
    return total


def _remembered(entries: int):
    """Short stretches repeat and are looked up; long ones seldom do and are worked out each time."""

    def wrap(f):
        short = lru_cache(maxsize=entries)(f)
        return lambda text, *rest: (short if len(text) <= REMEMBERED else f)(text, *rest)

    return wrap


@_remembered(100_000)
def _run(text: str, before: str, after: str) -> str:
    """A maximal run of non-ASCII characters with UTF-8 read as something else put right, or the run itself."""
    if len(text) < 2 or all(_kind(c) == "russian" for c in text) and not (before + after).isascii():
        return text
    if all(_kind(c) == "russian" for c in text) and not re.search("[A-Za-z]", before + after):
        return text
    best, least = text, cost(text, before, after)
    for encoding in READ_AS:
        raw = _sloppy(text, encoding)
        if raw is None:
            continue
        try:
            fixed = raw.decode("utf-8")
        except UnicodeError:
            continue
        now = cost(fixed, before, after)
        if now < least:
            best, least = fixed, now
    if best is text and _UTF8_IN_LATIN.search(raw1252 := "".join(chr(b[0]) if (b := _sloppy(c, "cp1252")) and len(b) == 1 else "࿿" for c in text)):
        out, at = [], 0
        for m in _UTF8_IN_LATIN.finditer(raw1252):
            out += [text[at : m.start()], m.group().encode("latin-1").decode("utf-8", "ignore")]
            at = m.end()
        fixed = "".join(out) + text[at:]
        if cost(fixed, before, after) < least:
            return fixed
    if best is text and any(_kind(c) == "wide" for c in text):
        best = _wide_run(text)
    return best


def _wide_run(text: str) -> str:
    """UTF-8 read as a multi-byte encoding. Three bytes of each character met the pairs of the wrong reading,
    so pieces between lost characters may lack a byte or two at their ends."""
    for encoding in READ_AS_WIDE:
        out, good, bad = [], 0, 0
        for piece in re.split("(�+)", text):
            if not piece or piece[0] == "�":
                out.append(piece)
                continue
            try:
                raw = piece.encode(encoding)
            except UnicodeError:
                bad += len(piece)
                out.append(piece)
                continue
            head = 0
            while head < len(raw) and head < 3 and 0x80 <= raw[head] <= 0xBF:
                head += 1
            for tail in range(min(3, len(raw) - head)):
                try:
                    fixed = raw[head : len(raw) - tail].decode("utf-8")
                    break
                except UnicodeError:
                    fixed = ""
            if fixed and sum(_kind(c) in ("wide", "mark") and ord(c) > 0x7FF for c in fixed) * 3 >= 0.8 * len(raw):
                good += len(piece)
                out.append("�" * bool(head) + fixed + "�" * bool(tail))
            else:
                bad += len(piece)
                out.append(piece)
        if good >= 2 and good > bad:
            return "".join(out)
    return text


def _russian_cost(text: str) -> float:
    """Mean unlikeliness of the letters, plus what wrong capitals add: inside a word, or everywhere."""
    total = n = 0
    for word in re.findall(r"[Ѐ-ӿ]+", text):
        for i, ch in enumerate(word):
            n += 1
            total += 4.8 - (RUSSIAN.get(ch.lower(), 0.02) ** 0.5) * 0.42
            if i and ch.isupper():
                total += 2.5 if word[i - 1].islower() else 0.8
    return total / max(1, n)


@_remembered(50_000)
def _cyrillic(text: str) -> str:
    """Cyrillic read as another Cyrillic encoding."""
    best, least = text, _russian_cost(text) - 0.5
    for read in CYRILLIC:
        raw = _sloppy(text, read)
        for meant in CYRILLIC if raw else ():
            if meant != read:
                try:
                    fixed = raw.decode(meant)
                except UnicodeError:
                    continue
                if re.fullmatch(r"[А-Яа-яЁё ,;:.!?()\-]+", fixed) and (now := _russian_cost(fixed)) < least:
                    best, least = fixed, now
    return best


def _high_latin(text: str) -> str:
    """Cyrillic read as Western: words of at least three letters without a plain one."""
    if not re.search(r"[\xc0-\xff]{3}", text):
        return text
    best, least = text, 1e9
    for meant in CYRILLIC:
        try:
            fixed = text.encode("latin-1").decode(meant)
        except UnicodeError:
            continue
        if re.fullmatch(r"[А-Яа-яЁё ,;:.!?()\-]+", fixed) and (now := _russian_cost(fixed)) < least:
            best, least = fixed, now
    return best


def _dense(text: str) -> str:
    """A double-byte encoding read as Western: a stretch in which a third or more is not ASCII."""
    high = len(re.findall(r"[^\x00-\x7f]", text))
    if high < 4 or high < 0.34 * len(text):
        return text
    return _double(text)


def _short(m: re.Match) -> str:
    """A run within other text: a double-byte encoding read as Western, if no language writes its letters, or signs
    among letters, in this way."""
    run = m.group()
    letters = {c for c in run if ord(c) > 0x7F and unicodedata.category(c)[0] == "L"}
    foreign = len(letters) > 1 and not any(letters <= a for a in _ALPHABETS) or letters and len(re.findall("[¢-¦¨©¬®¯±-¶¸¹¼-¾]", run)) > 1
    if not foreign and not _C1.search(run) and len(re.findall("[ƒ‚][^\x00-\x3f]", run)) < 2:
        return run
    if (fixed := _double(run)) != run or run[-1] > "\x7f":
        return fixed
    return _double(run[:-1]) + run[-1]


def _double(text: str) -> str:
    raw = _sloppy(text, "cp1252")
    if raw and len(raw.decode("utf-8", "ignore").encode()) > 0.9 * len(raw):
        return text
    for meant in WIDE if raw else ():
        for tail in (0, 1):
            try:
                fixed = raw[: len(raw) - tail].decode(meant)
            except UnicodeError:
                continue
            wide = sum(_kind(c) == "wide" or 0x3001 <= ord(c) <= 0x303F for c in fixed)
            if wide >= 2 and wide >= 0.7 * len(fixed.replace(" ", "")) and cost(fixed) < cost(text):
                return fixed
    return text


def _layer(text: str) -> str:
    def dense(m: re.Match) -> str:
        head, core, rest = re.fullmatch(r"([\x00-\x7f]*)(.*?)([ \n]*)", m.group(), re.S).groups()
        return head + _dense(core) + rest if core else m.group()

    # UTF-8 first: its strict form is not met by chance, while double-byte encodings accept almost anything.
    fixed = _RUN.sub(lambda m: _run(m.group(), text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]), text)
    if fixed != text:
        return fixed
    if _C1.search(text) or re.search("[\xa1-\xffŒ-˜–-™][\x20-\x7e]?[\xa1-\xffŒ-˜–-™]", text):
        text = _CP1252_STRETCH.sub(dense, text)
        text = _HIGH_LATIN_WORDS.sub(lambda m: _high_latin(m.group()), text)
        text = _DOUBLE_RUN.sub(_short, text)  # after Cyrillic, whose words double-byte encodings accept as well
    if re.search(r"[а-яё][А-ЯЁ]|[А-ЯЁ]{3}|[а-яё][А-ЯЁЂ-Џђ-џ]", text):
        text = _CAPITAL_WORDS.sub(lambda m: _cyrillic(m.group()), text)
        text = _CYRILLIC_WORDS.sub(lambda m: _cyrillic(m.group()), text)
    return _C1.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "replace").replace("�", m.group()), text) if _C1.search(text) else text


def repair(text: str) -> tuple[str, int, bool]:
    """(text put right, layers undone, whether characters are lost for good) of one text."""
    layers, seen = 0, {text}
    while (fixed := _layer(text)) not in seen:
        text, layers = fixed, layers + 1
        seen.add(text)
    return text, layers, bool(_LOST.search(text) or _C1.search(text))


def repaired(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, text, layers, lost) of every text that came out of a wrong decoding.

    ``text`` is the original as far as it can be had; ``lost`` tells that some of it cannot, so a text may
    appear with 0 layers undone. Null and empty texts, and texts that read well, are left out.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, value in zip(batch["_k"], batch["_t"]):
                fixed, layers, lost = repair(value)
                if layers or lost:
                    rows.append((key, fixed, layers, lost))
            yield pd.DataFrame(rows, columns=[item, "text", "layers", "lost"])

    high = df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(item).cast("long").alias("_k"), F.col(text).alias("_t"))
    return high.mapInPandas(work, f"{item} long, text string, layers int, lost boolean")
