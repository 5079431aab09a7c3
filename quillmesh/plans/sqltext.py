"""SQL for an independent engine: the text functions written out as expressions, and shared subqueries."""

from __future__ import annotations

from quillmesh.functions.text import STOPWORDS, SUFFIXES

STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"


def _pass(original: str, word: str) -> str:
    arms = []
    for suffix, new in SUFFIXES:
        stem = f"left({word}, length({word}) - {len(suffix)}) || '{new}'"
        arms.append(f"WHEN ends_with({word}, '{suffix}') AND length({word}) - {len(suffix) - len(new)} >= 3 AND NOT list_contains({STOP}, {stem}) THEN {stem}")
    return f"CASE WHEN length({original}) <= 3 OR NOT regexp_full_match({original}, '[A-Za-z]+') THEN {word} {' '.join(arms)} ELSE {word} END"


def words(expr: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace(coalesce({expr}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_.-]*')"


def terms(expr: str) -> str:
    parts = f"list_filter(regexp_split_to_array(w, '[_.-]+'), lambda p: length(p) >= 2 AND NOT list_contains({STOP}, p))"
    split = f"flatten(list_transform(list_filter({words(expr)}, lambda w: NOT list_contains({STOP}, w)), lambda w: CASE WHEN regexp_matches(w, '[_.-]') THEN list_prepend(w, {parts}) ELSE [w] END))"
    once = f"list_transform({split}, lambda w: {{'o': w, 'p': {_pass('w', 'w')}}})"
    return f"list_transform({once}, lambda s: {_pass('s.o', 's.p')})"


#: One row per note path: the latest version.
NOTES = "notes1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY generated_at DESC, note_id DESC) AS rn FROM notes) WHERE rn = 1)"
#: One row per repository and normal path: the latest scan.
SOURCES = r"""src AS (SELECT *, repository || ':' || p AS file FROM (SELECT *, row_number() OVER (PARTITION BY repository, p ORDER BY indexed_at DESC, record_id DESC) AS rn
FROM (SELECT *, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS p FROM source_records WHERE path IS NOT NULL)) WHERE rn = 1)"""
_HEADINGS = r"array_to_string(regexp_extract_all(coalesce(body, ''), '(?m)^#+\s+(.*)$', 1), ' ')"
NOTE_FIELDS = {"title": "title", "tags": "array_to_string(tags, ' ')", "description": "description", "headings": _HEADINGS, "body": "body"}


def postings(source: str, key: str, fields: dict[str, str], name: str = "posts") -> str:
    each = " UNION ALL ".join(f"SELECT {key}, '{f}' AS field, unnest({terms(e)}) AS term FROM {source}" for f, e in fields.items())
    return f"{name} AS (SELECT {key}, field, term, count(*) AS tf FROM ({each}) GROUP BY ALL)"


def cue_terms(source: str, cue: str, text: str, name: str = "cues") -> str:
    return f"{name} AS (SELECT {cue}, unnest(t) AS term, len(t) AS n_terms FROM (SELECT {cue}, list_distinct({terms(text)}) AS t FROM {source}))"


def weight(weights: dict[str, float], other: float = 0.0) -> str:
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in weights.items()) + f" ELSE {other} END"


def bm25f(posts: str, key: str, n: str, cues: str, cue: str, weights: dict[str, float], name: str = "bm") -> str:
    """CTEs ending in ``name``(cue, key, score)."""
    return f"""lens AS (SELECT {key}, field, sum(tf) AS len FROM {posts} GROUP BY ALL),
fstat AS (SELECT field, sum(len) / ({n}) AS avg_len FROM lens GROUP BY field),
dfs AS (SELECT term, count(DISTINCT {key}) AS df FROM {posts} GROUP BY term),
wtf AS (SELECT p.term, p.{key}, sum({weight(weights, 1.0)} * tf / (1 - 0.75 + 0.75 * len / avg_len)) AS w FROM {posts} p JOIN lens USING ({key}, field) JOIN fstat USING (field) GROUP BY ALL),
{name} AS (SELECT {cue}, {key}, round(sum(ln(1 + (({n}) - df + 0.5) / (df + 0.5)) * 2.2 * w / (1.2 + w)), 6) AS score FROM {cues} JOIN wtf USING (term) JOIN dfs USING (term) GROUP BY ALL)"""
