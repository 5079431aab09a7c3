"""Problem 6: credentials in source code, configuration and notes.

A keyword automaton runs over each whole text; only lines that hold a keyword are looked at by the
issuer-format and assignment patterns, each hit is validated by its structure, and what remains is replaced
by a placeholder of the same length and alphabet, so that the code around it still parses. Where an issuer has
published how its tokens carry a checksum, it is computed and reported with the hit; a wrong one drops none,
as a mistyped or retired token is still no text to train on.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The automaton's keywords, in lower case.
KEYWORDS = (
    "pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login", "basic ", "dsn", "://", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "hbx-",
    "_live_", "_test_", "_prod_", "eyj", "aiza", "sg.", "npm_", "pypi-", "sk-", "begin ", "hooks.", "webhook", " -p", " -u ", "spare", "rotated", "pin ", "passwd", "cookie", "signature", "salt",
    "xapp-", "dapi", "gocspx-", "ya29.", "shpat_", "shpca_", "shppa_", "shpss_", "sq0", "dop_v1_", "hf_", "hvs.", "lin_api_", "pmak-", "glsa_", "glc_", "nrak-", "age-secret", "atatt3", "rubygems_", "tfp_", "pat_", "-----",
)
# What issuers' credentials look like.
ISSUERS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:"
    r"(?P<cloud_key>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"
    r"|(?P<forge_token>gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,})"
    r"|(?P<chat_token>xox[abeoprs]-[A-Za-z0-9-]{20,})"
    r"|(?P<service_key>[a-z]{2,8}_(?:live|test|prod)_[A-Za-z0-9]{16,})"
    r"|(?P<grouped_key>hbx-(?:[a-z0-9]{6}-){3}[a-z0-9]{6})"
    r"|(?P<jwt>eyJ[A-Za-z0-9_-]{8,}={0,2}\.eyJ[A-Za-z0-9_-]{4,}={0,2}\.[A-Za-z0-9_-]{16,})"
    r"|(?P<search_key>AIza[A-Za-z0-9_-]{35})"
    r"|(?P<mail_key>SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{30,})"
    r"|(?P<registry_token>npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,})"
    r"|(?P<model_key>sk-(?:[a-z]+-)?[A-Za-z0-9]{32,})"
    r"|(?P<app_token>xapp-\d-[A-Z0-9]{8,}-\d{8,}-[A-Za-z0-9]{32,})"
    r"|(?P<workspace_token>dapi[0-9a-f]{32}(?:-\d)?)"
    r"|(?P<oauth_secret>GOCSPX-[A-Za-z0-9_-]{28}|ya29\.[A-Za-z0-9_-]{30,})"
    r"|(?P<shop_token>shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|sq0[a-z]{3}-[A-Za-z0-9_-]{22,})"
    r"|(?P<host_token>dop_v1_[0-9a-f]{64}|hf_[A-Za-z]{34}|hvs\.[A-Za-z0-9_-]{24,}|lin_api_[A-Za-z0-9]{40}|PMAK-[0-9a-f]{24}-[0-9a-f]{34}|glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}|glc_[A-Za-z0-9+/]{32,}={0,2}|NRAK-[A-Z0-9]{27}|ATATT3[A-Za-z0-9_=-]{60,}|rubygems_[0-9a-f]{48})"
    r"|(?P<age_key>AGE-SECRET-KEY-1[0-9A-Z]{58})"
    r")"
)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]*://(?P<user>[^\s:/@\"'<>`]*):(?P<value>[^\s/@\"'<>`]+)@[A-Za-z0-9\[]")
_HOOK = re.compile(r"\bhttps?://[\w.-]*\bhooks?\.[\w.-]+/(?:[\w-]+/)*(?P<value>[A-Za-z0-9_-]{20,})|\bhttps?://[\w.-]+/(?:api/)?(?:webhooks?|services)/(?:[\w-]+/)+(?P<value2>[A-Za-z0-9_-]{20,})")
_BASIC = re.compile(r"\bBasic\s+(?P<value>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")
_BEARER = re.compile(r"\bBearer\s+(?P<value>[^\s\"'`,;<>]{8,})")
_FLAG = re.compile(r"(?<=\s)(?:-p|--password[= ]|--token[= ]|--pass[= ])(?P<q>[\"']?)(?P<value>[^\s\"']{8,})(?P=q)|(?<=\s)-u\s+[\"']?[\w.-]+:(?P<value2>[^\s\"']{6,})")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`")
_ASSIGN = re.compile(r"(?P<name>[A-Za-z_][\w.-]*)(?P<nq>[\"'`]?)\]?\s*(?::=|=>|[:=](?![:=]))\s*(?:\(\s*)?")
_BARE = re.compile(r"[^\s,;\"'`()\[\]{}<>|&]+(?=[\s,;|&)\]}]|$)")
_CALL = re.compile(r"\b(?P<name>[A-Za-z_]\w*)\(\s*(?=[\"'])")
_HOLDER = re.compile(r"\b(?:class|struct|enum|object)\s+(?P<name>\w+)\s*\{[^\"'\n]*=\s*(?=[\"'])")
_NEXT_PART = re.compile(r"[ \t]*(?:\+|\.|\\)?[ \t]*\r?\n[ \t]*(?:\+[ \t]*)?(?=[\"'`])")
_SAID = re.compile(r"(?i)\b(?:password|passwd|passphrase|secret|token|credentials?|login|api[ _-]?key|access[ _-]?key|key|bearer)\b(?:[^\n]{0,48}?(?:\bis\b|\bwas\b|:|=|\b(?:token|login|password|key|credential|secret)))?\s+[\"'`(]?(?P<value>[^\s\"'`,;()<>]{8,})")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Names of secrets, and names that only speak of them.
_SECRET_WORDS = {"password", "passwd", "pwd", "passphrase", "passcode", "pass", "secret", "secrets", "token", "apikey", "bearer", "credential", "credentials", "pgpassword", "apitoken", "authtoken", "accesskey", "secretkey", "privatekey"}
_KEY_KINDS = {"api", "access", "client", "hmac", "signing", "private", "secret", "encryption", "encrypt", "master", "account", "service", "deploy", "admin", "storage", "shared", "ssh", "session", "auth", "webhook", "license"}
_NOT_SECRET = {"hash", "hashed", "digest", "checksum", "count", "limit", "length", "len", "min", "max", "size", "budget", "public", "fingerprint", "type", "field", "ttl", "expiry", "expires", "header", "prefix", "pattern", "regex", "policy", "hint", "sha", "integrity", "commit", "trace", "ref", "path", "file", "url", "name", "estimate"}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:change[-_ ]?(?:me|it|this)?|replace[-_ ]?(?:me|this)?|your[-_ ].*|my[-_ ].*|insert.*|enter[-_ ].*|put[-_ ].*|example.*|dummy.*|fake.*|placeholder.*|sample.*|none|null|nil|undefined|true|false|todo|tbd|fixme|redacted|masked|hidden|secret|password|passwd|token|"
    r"<.*>|\[.*\]|\{\{.*\}\}|.*\bhere\b.*|x+|\*+|\.+|-+|_+|0+|#+|abc123|foobar|test(?:ing|123)?)$|(?i:change[-_]?me|your[-_](?:api|token|key|password|secret)|replace[-_]me|placeholder|redacted|not[-_ ]a[-_ ]?real)|^(?:[xX*.#•0-]{4,}[- ]?)+$"
)
_REFERENCE = re.compile(r"(?i)^(?:\$|%[({]|\{\{|@|vault:|kv[/:]|env[.:]|file:|arn:|ssm:|op://|secretref|secretmanager|keychain|keyring|ref\+|!|&|\*)|\b(?:os\.environ|getenv|process\.env|config\.|settings\.|secrets\.|System\.)|^(?:[\w.-]+/)+[\w.-]+\.\w{1,5}$|^/[\w./-]*$")
_HASHED = re.compile(r"^(?:\$(?:2[abxy]|argon2\w*|[156]|pbkdf2[\w-]*|scrypt)\$|\{(?:S?SHA|MD5)|(?:sha(?:1|224|256|384|512)|md5|blake\w*)[-:])", re.I)
_SPLIT_ID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)


@lru_cache(maxsize=50_000)
def names_secret(name: str) -> bool:
    """Whether an identifier names a secret rather than something about one."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or any(w in _NOT_SECRET for w in words):
        return False
    if any(w in _SECRET_WORDS for w in words):
        return True
    return any(a in _KEY_KINDS and b in ("key", "keys", "token", "auth") for a, b in zip(words, words[1:])) or words[-1:] == ["key"] and words[0] in _KEY_KINDS


def _groups(value: str) -> int:
    return bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search(r"\d", value)) + bool(re.search(r"[^A-Za-z0-9]", value))


def plausible(value: str, least: int = 8) -> bool:
    """Whether ``value`` can be a live secret: no placeholder, reference, hash, word or path."""
    if len(value) < least or re.search(r"\s", value) or _PLACEHOLDER.search(value) or _REFERENCE.search(value) or _HASHED.match(value) or _SPLIT_ID.match(value):
        return False
    if not re.search(r"\d", value):
        if re.fullmatch(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*", value):
            # Letters alone are random only where their case turns more often than at the words of a name.
            turns = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
            return len(value) >= 16 and turns >= 0.4 * (len(value) - 1)
        return len(value) >= 16 and _groups(value) >= 2 and bool(re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value))
    if re.fullmatch(r"[\d.,:_/-]+", value) or re.fullmatch(r"(?:[A-Za-z]+[_.-])*[A-Za-z]+[_.-]?\d{1,3}", value) and value == value.lower():
        return False
    if len(set(value)) < max(4, min(16, len(value) // 8)):
        return False
    return _groups(value) >= 3 or len(value) >= 12 and _groups(value) >= 2


def _said_value(value: str) -> bool:
    """The stricter rule for values that stand in prose or comments."""
    value = value.rstrip(".:!?")
    if not re.fullmatch(r"[A-Za-z0-9+][^\\{}\x00-\x20\x7f-\uffff]*", value):
        return False
    return plausible(value, 10) and not re.search(r"[/\\]\w+\.\w+$|^https?:|\(\)|^[\w.-]+@[\w.-]+\.\w+$|^@?[\w-]+/[\w-]+(?:@[\d.]+)?$", value) and (_groups(value) >= 3 or bool(re.fullmatch(r"[0-9a-f]{20,}|[A-Za-z0-9+/_-]{24,}", value)))


def _basic(value: str) -> bool:
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeError):
        return False
    user, sep, password = text.partition(":")
    return bool(sep and user and len(password) >= 4 and text.isprintable() and not _PLACEHOLDER.search(password))


def _jwt(value: str) -> bool:
    try:
        head = value.split(".")[0]
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in KEYWORDS:
        automaton.add_word(word, 1)
    automaton.make_automaton()
    return automaton


def _literal(text: str, at: int) -> tuple[str, list[tuple[int, int]]] | None:
    """The value of the string literal at ``at`` and of those joined to it on the following lines, with their spans."""
    m = _STRING.match(text, at)
    if not m:
        return None
    parts, spans = [m.group()[1:-1]], [(m.start() + 1, m.end() - 1)]
    while (join := _NEXT_PART.match(text, m.end())) and (m := _STRING.match(text, join.end())):
        parts.append(m.group()[1:-1])
        spans.append((m.start() + 1, m.end() - 1))
    return "".join(parts), spans


_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID)[ \t]*:")
_EDGES = " \t\r\"'`,;#*>|()[]+\\"
_KEY_CHARS = re.compile(r"(?<!\\)[A-Za-z0-9+/=]+")


def _key_lines(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """(end, spans) of the key material that follows a BEGIN line at ``at`` and has no END line: as long as lines hold
    nothing but key characters, however many; headers and a blank line after them may come first."""
    end, spans = at, []
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop].strip(_EDGES)
        plain = re.sub(r"\\[nrt]", " ", line).strip(_EDGES)
        if not plain:
            if spans:
                break
        elif not (_HEADER.match(plain) and not spans):
            if not re.fullmatch(r"[A-Za-z0-9+/= \t\\]+", plain):
                break
            groups = plain.split()  # words of prose seldom hold a digit
            if 2 * sum(bool(re.search(r"[0-9+/=]|[A-Za-z]{24}", g)) for g in groups) < len(groups):
                break
            spans += [m.span() for m in _KEY_CHARS.finditer(text, at, stop)]
            end = stop
        at = stop + 1
    return end, spans


def _base62(number: int, width: int) -> str:
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out = ""
    while number:
        number, d = divmod(number, 62)
        out = digits[d] + out
    return out.rjust(width, "0")


def checksum(value: str) -> str | None:
    """'valid' or 'invalid' for a token whose issuer has published its checksum, None for any other.

    Tokens of 36 letters and digits after ``gh?_`` or ``npm_`` end in six base-62 digits of the CRC-32 of the rest; a
    signed token's three parts must be whole base-64 texts, the first two of them JSON objects.
    """
    if m := re.fullmatch(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})", value):
        return "valid" if _base62(zlib.crc32(m[1].encode()), 6) == m[2] else "invalid"
    if value.startswith("eyJ") and value.count(".") == 2:
        head, body, _ = value.split(".")
        return "valid" if _jwt(head) and _jwt(body) else "invalid"
    return None


def find(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(kind, spans) of each credential in ``text``, by position; several spans where a literal is split."""
    low = text.lower()
    if len(low) != len(text):  # some letters have longer lower forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts, last = [], -1
    for end, _ in _automaton().iter(low):
        if end > last:
            start = text.rfind("\n", 0, end + 1) + 1
            last = text.find("\n", end)
            last = len(text) if last < 0 else last
            starts.append((start, last))
    found: list[tuple[str, list[tuple[int, int]]]] = []
    taken: list[tuple[int, int]] = []  # disjoint and in order

    def free(a: int, b: int) -> bool:
        i = bisect_right(taken, (a, a))
        return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b)

    def add(kind: str, spans: list[tuple[int, int]]) -> None:
        if all(free(a, b) for a, b in spans):
            found.append((kind, spans))
            for span in spans:
                taken.insert(bisect_right(taken, span), span)

    key_end = -1
    for start, stop in starts:
        if start < key_end:
            continue
        line = text[start:stop]
        if m := _BEGIN.search(line):
            body = start + m.end()
            end = _END.search(text, body)
            following = _BEGIN.search(text, body)
            if end and (not following or end.start() < following.start()):
                stop = end.start()
                rows = [r.span() for r in _KEY_CHARS.finditer(text, body, stop) if not _HEADER.match(text, text.rfind("\n", 0, r.start()) + 1)]
            else:
                stop, rows = _key_lines(text, body)
            if sum(b - a for a, b in rows) >= 40 and "..." not in text[body:stop]:
                add("private_key", [(start + m.start(), start + m.end()), *rows])
                key_end = stop
            continue
        for m in ISSUERS.finditer(line):
            if m.lastgroup == "jwt" and not _jwt(m.group()) or _PLACEHOLDER.search(m.group()):
                continue
            if len(set(m.group()[6:])) >= 4:
                add(m.lastgroup, [(start + m.start(), start + m.end())])
        for m in _URL.finditer(line):
            if not _PLACEHOLDER.search(m["value"]) and not _REFERENCE.search(m["value"]) and not re.match(r"[<{%]", m["value"]):
                add("url_password", [(start + m.start("value"), start + m.end("value"))])
        for m in _HOOK.finditer(line):
            g = "value" if m["value"] else "value2"
            if re.search(r"\d", m[g]) and re.search("[A-Za-z]", m[g]) and not _PLACEHOLDER.search(m[g]):
                add("webhook", [(start + m.start(g), start + m.end(g))])
        for m in _BASIC.finditer(line):
            if _basic(m["value"]):
                add("basic_login", [(start + m.start("value"), start + m.end("value"))])
        for m in _BEARER.finditer(line):
            if plausible(m["value"].rstrip("\"'")):
                add("bearer", [(start + m.start("value"), start + m.start("value") + len(m["value"].rstrip("\"'")))])
        for m in _FLAG.finditer(line):
            g = "value" if m["value"] else "value2"
            if plausible(m[g]):
                add("argument", [(start + m.start(g), start + m.end(g))])
        for pattern in (_ASSIGN, _CALL, _HOLDER):
            for m in pattern.finditer(line):
                if not names_secret(m["name"]):
                    continue
                at = start + m.end()
                if pattern is _ASSIGN and at >= stop and text[at - 1] == "(" or line[m.end() :].strip() in ("", "("):
                    skip = re.compile(r"[ \t]*\(?[ \t]*\r?\n[ \t]*(?=[\"'`])").match(text, at)
                    at = skip.end() if skip and pattern is _ASSIGN and line.rstrip().endswith(("(", "=")) else at
                if literal := _literal(text, at):
                    value, spans = literal
                elif pattern is _ASSIGN and (bare := _BARE.match(text, at, stop)):
                    value, spans = bare.group(), [bare.span()]
                    after = text[bare.end() : bare.end() + 1]
                    if after in ("(", "[") or after == ";" and re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+", value):
                        continue  # a call, a subscript, or a member in a statement
                else:
                    continue
                if plausible(value):
                    add("assignment", spans)
                elif m2 := ISSUERS.fullmatch(value):
                    add(m2.lastgroup, spans)
        # An issuer's credential or URL may also be split over literals that no telling name is given to.
        for m in re.finditer(r"[\"'](?=(?:gh[pousr]_|xox|AKIA|eyJ|hbx-|[a-z]{2,8}_live_|[a-z]+://))", line):
            literal = _literal(text, start + m.start())
            if literal and len(literal[1]) > 1:
                value, spans = literal
                if ISSUERS.fullmatch(value) or (u := _URL.search(value)) and not _PLACEHOLDER.search(u["value"]) or _HOOK.search(value):
                    add("split", spans)
        for m in _SAID.finditer(line):
            value = m["value"].rstrip(".:!?")
            if _said_value(value):
                add("said", [(start + m.start("value"), start + m.start("value") + len(value))])
    found.sort(key=lambda f: f[1][0])
    return found


def _mask(value: str) -> str:
    """Same length, same alphabet: letters of each case, digits and signs stay of their kind."""
    return re.sub("[A-Z]", "X", re.sub("[a-z]", "x", re.sub(r"\d", "0", value)))


def redact(text: str) -> tuple[str, int]:
    """(``text`` with every credential masked, how many there are); armour lines of private keys stay."""
    found = find(text)
    spans = [(a, b) for kind, s in found for a, b in (s[1:] if kind == "private_key" else s)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], _mask(text[a:b])]
            at = b
    return "".join(out) + text[at:], len(found)


def credentials(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, line_no, kind, length, checksum): each credential at the line on which it begins, and what its issuer's
    checksum says where one is known. Null and empty texts have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, value.count("\n", 0, spans[0][0]) + 1, kind, sum(b - a for a, b in spans), checksum("".join(value[a:b] for a, b in spans)))
                for key, value in zip(batch["_k"], batch["_t"])
                for kind, spans in find(value)
            ]
            yield pd.DataFrame(rows, columns=[item, "line_no", "kind", "length", "checksum"])

    rows = df.where(F.length(text) > 0).select(F.col(item).cast("long").alias("_k"), F.col(text).alias("_t"))
    return rows.mapInPandas(work, f"{item} long, line_no long, kind string, length long, checksum string")


def redacted(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, text, n): every text with its credentials masked, and how many there were. Null texts stay null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [redact(t) if t else (t, 0) for t in batch["_t"]]
            yield pd.DataFrame({item: batch["_k"], "text": [t for t, _ in done], "n": [n for _, n in done]})

    return df.select(F.col(item).cast("long").alias("_k"), F.col(text).alias("_t")).mapInPandas(work, f"{item} long, text string, n int")
