"""Typed relations between people and organisations: from links, from prose, and one-hop answers to questions about them.

A relation is known by a small vocabulary, its verbs and the nouns of both its ends; the forms of questions and of
statements are put together from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import graph

# Of each relation the base, third-person, past and continuous verbs, the preposition that follows, the
# nouns of its person and the types of its other end.
VOCABULARY = {
    "attended": (("attend", "join"), ("attends", "joins"), ("attended", "joined"), ("attending",), "", ("attendee", "participant"), ("meeting",)),
    "works_at": (("work",), ("works",), ("worked",), ("working",), "at|for|with", ("employee", "member of staff", "team member"), ("company", "fund")),
    "founded": (("found", "start", "co-found", "cofound"), ("founds", "starts", "co-founds", "cofounds"), ("founded", "started", "co-founded", "cofounded"), ("founding",), "", ("founder", "co-founder", "cofounder"), ("company", "fund")),
    "invested_in": (("invest",), ("invests",), ("invested",), ("investing",), "in", ("investor", "backer"), ("company", "fund")),
    "advises": (("advise",), ("advises",), ("advised",), ("advising",), "", ("adviser", "advisor"), ("company", "fund")),
}
# Further names of relations in typed links; verbs that need no preposition; roles; words for types.
LINK_NAMES = {"attends": "attended", "attendee": "attended", "joined": "attended", "works at": "works_at", "works for": "works_at", "employed by": "works_at", "employee of": "works_at", "founder of": "founded", "started": "founded", "co founded": "founded", "invested in": "invested_in", "investor in": "invested_in", "backed": "invested_in", "advisor to": "advises", "adviser to": "advises", "advised": "advises"}
BARE = {"back": "invested_in", "backs": "invested_in", "backed": "invested_in"}
ROLE_WORDS = (*T.ROLES, *sorted(set(T.ROLES.values())), "president", "chair", "partner", "head of engineering", "head of product", "head of sales")
TYPES = {"person": ("person", "people", "who", "whom"), "company": ("company", "companies", "organisation", "organisations", "organization", "organizations", "startup", "startups", "firm", "firms", "employer", "employers"), "fund": ("fund", "funds"), "meeting": ("meeting", "meetings", "event", "events")}
_TYPE_OF = {word: kind for kind, words in TYPES.items() for word in words}
MAX_QUESTION = 128


def _any(words) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True)) + ")"


def _after(prep: str) -> str:
    return rf"\s+(?:{prep})" if prep else ""


_FORMER = r"(?:used to|formerly|previously|once|no longer|in the past)"
_NOW = r"(?:currently|now|still|today|at present)"
_TIME = rf"(?:(?P<past>{_FORMER})|(?P<now>{_NOW}))"
_ASKED = rf"(?P<kind>{_any(_TYPE_OF)})"


@dataclass(frozen=True)
class Request:
    """One seed, one relation, one direction (``out`` asks for what the seed is related to), and what the answer must be."""

    seed: str
    relation: str
    direction: str
    answer: tuple[str, ...] = ()
    qualifier: str = ""
    tense: str = ""


def _templates() -> list[tuple[re.Pattern, str, str]]:
    """(pattern, relation, direction) of all forms of questions."""
    out = []
    seed = r"(?P<seed>.+?)"
    for relation, (base, third, past, going, prep, nouns, others) in VOCABULARY.items():
        after = _after(prep)
        bare = [w for w, r in BARE.items() if r == relation]
        said = rf"(?:{_any((*third, *past))}{after}" + (rf"|{_any(bare)}" if bare else "") + rf"|(?:is|are|was|were)\s+{_any(going)}{after})"
        doing = rf"(?:{_any((*base, *past))}" + (rf"|{_any(bare)}" if bare else "") + ")"
        who = r"(?:who|which people|what people|which person)"
        ask = r"(?:(?:what|which)(?:\s+\w+)??\s+(?P<kind>\w+)|what|which|who|whom|where)"
        out += [
            # Who founded X?  Who used to work at X?  Who has invested in X?
            (rf"{who}\s+(?:has\s+|have\s+|had\s+)?(?:{_TIME}\s+)?(?:{said}|{_any(base)}{after})(?:\s+(?P<now2>{_NOW}))?\s+{seed}(?:\s+(?P<now3>{_NOW}))?", relation, "in"),
            # Who are the founders of X?  List the investors in X.  X's founders
            (rf"(?:who\s+(?:is|are|was|were)\s+|list\s+|show\s+(?:me\s+)?|name\s+|find\s+)?(?:all\s+)?(?:the\s+|an?\s+)?(?:(?P<past>former|past|previous|ex)[ -]|(?P<now>current|present)\s+)?{_any((*nouns, *(n + 's' for n in nouns)))}\s+(?:of|in|at|for|to)\s+{seed}", relation, "in"),
            (rf"(?:who\s+(?:is|are|was|were)\s+)?{seed}['’]s?\s+(?:(?P<past>former|past|previous)\s+|(?P<now>current)\s+)?{_any((*nouns, *(n + 's' for n in nouns)))}", relation, "in"),
            # What did X found?  Which companies has X invested in?  Where does X work?
            (rf"{ask}\s+(?:has|have|had|did|does|do)\s+{seed}\s+(?:{_TIME}\s+)?{doing}(?:\s+(?:{prep or 'in'}))?(?:\s+(?P<now2>{_NOW}))?", relation, "out"),
            (rf"{ask}\s+(?:is|was)\s+{seed}\s+(?:{_TIME}\s+)?{_any((*going, *nouns))}(?:\s+(?:{'|'.join(filter(None, (prep, 'of', 'to', 'in')))}))?", relation, "out"),
            # For X, who founded it?
            (rf"(?:for|about|regarding)\s+{seed},\s+{who}\s+(?:has\s+|have\s+)?(?:{_TIME}\s+)?(?:{said})(?:\s+(?:it|them|there))?", relation, "in"),
            (rf"(?:for|about|regarding)\s+{seed},\s+{ask}\s+(?:has|have|did|does|do)\s+(?:he|she|they)\s+{doing}{f'(?:{after})?' if after else ''}", relation, "out"),
        ]
        if relation == "works_at":
            role = rf"(?P<role>{_any(ROLE_WORDS)})"
            out += [
                (rf"who\s+(?:is|are|was)\s+(?:the\s+)?(?:(?P<past>former|past|previous)\s+|(?P<now>current)\s+)?{role}\s+(?:of|at)\s+{seed}", relation, "in"),
                (rf"(?:who\s+(?:is|was)\s+)?{seed}['’]s?\s+(?:(?P<past>former)\s+|(?P<now>current)\s+)?{role}", relation, "in"),
                (rf"{ask}\s+(?:is|was)\s+{seed}\s+(?:the\s+)?{role}\s+(?:of|at)", relation, "out"),
                (rf"(?:who|what)\s+(?:is|was)\s+{seed}['’]s?\s+(?:(?P<past>former|previous)\s+|(?P<now>current)\s+)?(?P<kind>employers?)", relation, "out"),
            ]
    return [(re.compile(rf"(?i)^{p}\s*[?.!]*$"), r, d) for p, r, d in out]


_TEMPLATES = _templates()
_TWO = re.compile(r"(?i)\b(?:and|or|but)\s+(?:who|what|which|where|whom|when|how|why)\b|\?.+\?|;")


def parse(question: str) -> Request | None:
    """The one request of a question, or None: what asks two things, is too long, or fits no form asks for none."""
    q = " ".join(question.split())
    if not q or len(q.split()) > MAX_QUESTION or _TWO.search(q):
        return None
    for pattern, relation, direction in _TEMPLATES:
        if m := pattern.match(q):
            got = m.groupdict()
            seed = got["seed"].strip(" \t'\"“”’.,").casefold()
            if not seed or re.search(r"\b(?:who|what|which|where)\b", seed):
                continue
            kind = _TYPE_OF.get((got.get("kind") or "").lower())
            answer = ("person",) if direction == "in" else (kind,) if kind else VOCABULARY[relation][6]
            tense = "past" if got.get("past") or re.search(rf"(?i)\b{_FORMER}\b|\bformer\b", q) else "current" if any(got.get(k) for k in ("now", "now2", "now3")) else ""
            role = " ".join((got.get("role") or "").lower().split())
            return Request(re.sub(r"^the\s+", "", seed), relation, direction, answer, T.ROLES.get(role, role.replace(" ", "_")), tense)
    return None


def requests(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seed, relation, direction, answer, qualifier, tense) of the questions that make one request."""
    kind = questions.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, r.seed, r.relation, r.direction, list(r.answer), r.qualifier, r.tense) for k, t in zip(batch["_k"], batch["_t"]) if t and (r := parse(t))]
            yield pd.DataFrame(rows, columns=[key, "seed", "relation", "direction", "answer", "qualifier", "tense"])

    return questions.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(work, f"{key} {kind}, seed string, relation string, direction string, answer array<string>, qualifier string, tense string")


# --- statements ---------------------------------------------------------------------------------------------

_LINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]")
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?](?!\s|$)[^.!?\n]*)*[.!?]?")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|^[ \t]*>[^\n]*$", re.M)
# What keeps a sentence from stating anything.
_DOUBTED = re.compile(
    r"(?i)\?\s*$|\b(?:not|never|neither|nor|without|cannot)\b|n['’]t\b|\b(?:may|might|could|would|should|will|shall|must|can)\b|\b(?:if|unless|whether|suppose|supposedly|perhaps|maybe|probably|possibly|allegedly|reportedly|rumou?red?|apparently|hypothetical(?:ly)?)\b"
    r"|\b(?:plans?|planned|planning|hopes?|hoped|wants?|wanted|intends?|intended|considers?|considered|considering|declined|refused|failed|offered|asked|invited)\b[^.]*\bto\b|\baccording to\b|\b(?:said|says|claims?|claimed|believes?|believed|thinks?|thought|wrote|denie[sd])\b"
)
_MARK = "\x01{}\x02"
_NAMED = r"\x01(\d+)\x02"
_LIST = rf"{_NAMED}(?:(?:\s*,\s*(?:and\s+)?|\s+and\s+){_NAMED})*"


def _statements() -> list[tuple[re.Pattern, str, bool]]:
    """(pattern, relation, whether the second end is the person) of all forms of statements over marked links."""
    lead = rf"(?:\s+(?:has|have|had|also|both|then|later|recently|{_FORMER}|{_NOW}))*\s+"
    tail = r"(?:\s+the|\s+a)?\s+"
    role = rf"(?P<role>{_any(ROLE_WORDS)})"
    out = []
    for relation, (base, third, past, going, prep, nouns, _) in VOCABULARY.items():
        bare = [w for w, r in BARE.items() if r == relation]
        verb = rf"(?:{_any((*base, *third, *past))}{_after(prep)}" + (rf"|{_any(bare)}" if bare else "") + rf"|(?:is|are|was|were)\s+(?:{_FORMER}\s+|{_NOW}\s+)?{_any(going)}{_after(prep)})"
        noun = _any((*nouns, *(n + "s" for n in nouns)))
        out += [
            (rf"(?P<left>{_LIST}){lead}{verb}{tail}(?P<right>{_LIST})", relation, False),
            (rf"(?P<left>{_LIST})\s+(?:is|are|was|were|became)\s+(?:{_FORMER}\s+|{_NOW}\s+)?(?:an?\s+|the\s+)?(?:former\s+|current\s+|early\s+|first\s+)?{noun}\s+(?:of|in|at|to|for){tail}(?P<right>{_LIST})", relation, False),
            (rf"(?P<left>{_LIST})\s+(?:has\s+been|is|are|was|were)\s+{_any(past)}(?:\s+(?:{prep}))?\s+by\s+(?P<right>{_LIST})", relation, True),
        ]
        if relation == "works_at":
            out += [
                (rf"(?P<left>{_LIST})(?:\s*,\s*(?:the\s+)?|\s+(?:is|was|became)\s+(?:{_FORMER}\s+|{_NOW}\s+)?(?:the\s+|an?\s+)?)(?:former\s+|current\s+)?{role}\s+(?:of|at){tail}(?P<right>{_LIST})", relation, False),
                (rf"(?P<left>{_LIST}){lead}(?:joined|serves|served|works|worked)(?:\s+at|\s+for)?{tail}(?P<right>{_LIST})\s+as\s+(?:the\s+|its\s+|their\s+|an?\s+)?{role}", relation, False),
                (rf"(?P<left>{_LIST}){lead}left{tail}(?P<right>{_LIST})", relation, False),
            ]
    return [(re.compile(f"(?i){p}"), r, turned) for p, r, turned in out]


_STATEMENTS = _statements()
_PRONOUN = re.compile(r"(?i)^(\W*)(?:he|she|they)\b")
_OF_PAST = re.compile(rf"(?i)\b(?:{_FORMER}|former|left|was|were)\b")


def stated(body: str, own: str) -> list[tuple[str, str, str, str, str]]:
    """(first name, relation, second name, qualifier, tense) of what a body states about linked names.

    Quotations and quoted blocks, questions, negations, wishes, doubts, conditions and what others say state nothing.
    A sentence that begins with he, she or they is about the first name of the sentence before it, or about the
    note itself (``own``). Names joined by commas and ``and`` are each an end. A person may stand at either end.
    """
    out: list[tuple[str, str, str, str, str]] = []
    last = own
    for sentence in _SENTENCE.findall(_QUOTED.sub(" ", body)):
        names: list[str] = []

        def mark(m: re.Match) -> str:
            names.append(m[1])
            return _MARK.format(len(names) - 1)

        text = _LINK.sub(mark, sentence.strip().lstrip("-*+ \t"))
        if _PRONOUN.match(text):
            names.append(last)
            text = _PRONOUN.sub(lambda m: m[1] + _MARK.format(len(names) - 1), text, count=1)
        elif names:
            last = names[0]
        if len(names) < 2 or _DOUBTED.search(_LINK.sub("", text)) and not re.search(r"(?i)\bno longer\b", text):
            continue
        for pattern, relation, turned in _STATEMENTS:
            for m in pattern.finditer(text):
                ends = [[names[int(i)] for i in re.findall(_NAMED, m[side])] for side in ("left", "right")]
                left, right = ends[::-1] if turned else ends
                role = " ".join((m.groupdict().get("role") or "").lower().split())
                tense = "past" if relation == "works_at" and (_OF_PAST.search(m.group()) or re.search(r"(?i)\bworked\b", m.group())) else ""
                out += [(a, relation, b, T.ROLES.get(role, role.replace(" ", "_")), tense) for a in left for b in right]
    return list(dict.fromkeys(out))


def from_prose(notes: DataFrame, key: str, body: str) -> DataFrame:
    """(key, n, first, relation, second, qualifier, tense) of what each body states, code and comments apart."""
    kind = notes.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, *s) for k, t in zip(batch["_k"], batch["_t"]) for n, s in enumerate(stated(t, f"\x00{k}"))]
            yield pd.DataFrame(rows, columns=[key, "n", "first", "relation", "second", "qualifier", "tense"])

    linked = notes.where(F.col(body).contains("[["))
    return linked.select(F.col(key).alias("_k"), graph.mask_code(F.col(body)).alias("_t")).mapInPandas(work, f"{key} {kind}, n int, first string, relation string, second string, qualifier string, tense string")


def edges(typed: DataFrame, types: DataFrame, stated_: DataFrame | None = None) -> DataFrame:
    """(subject, relation, object, qualifier, tense, ordinal) of typed links (path, relation, target) and of statements
    (path, n, first, relation, second, qualifier, tense) whose ends are paths; people are the subjects.

    ``types`` gives (path, type). What has no person or two is no relation of this kind, nor is one whose other end is
    of a type that the relation does not lead to. Each edge once, numbered in the order of its note and place.
    """
    alias = F.create_map(*(F.lit(x) for pair in ({r: r for r in VOCABULARY} | LINK_NAMES).items() for x in pair))
    plain = F.lower(F.regexp_replace("relation", "[-_]", " "))
    named = typed.select("path", F.lit(-1).alias("n"), F.col("path").alias("first"), F.coalesce(F.element_at(alias, F.replace(plain, F.lit(" "), F.lit("_"))), F.element_at(alias, plain)).alias("relation"), F.col("target").alias("second"), F.lit("").alias("qualifier"), F.lit("").alias("tense"))
    rows = named.where("relation IS NOT NULL")
    if stated_ is not None:
        rows = rows.unionByName(stated_.select(*rows.columns))
    both = rows.join(types.select(F.col("path").alias("first"), F.col("type").alias("ft")), "first").join(types.select(F.col("path").alias("second"), F.col("type").alias("st")), "second")
    forward, backward = (F.col("ft") == "person") & (F.col("st") != "person"), (F.col("ft") != "person") & (F.col("st") == "person")
    turned = both.where(forward | backward).select("path", "n", F.when(forward, F.col("first")).otherwise(F.col("second")).alias("subject"), "relation", F.when(forward, F.col("second")).otherwise(F.col("first")).alias("object"), F.when(forward, F.col("st")).otherwise(F.col("ft")).alias("_o"), "qualifier", "tense")
    fits = F.lit(False)
    for relation, words in VOCABULARY.items():
        fits = fits | (F.col("relation") == relation) & F.col("_o").isin(*words[6])
    once = turned.where(fits).groupBy("subject", "relation", "object", "qualifier", "tense").agg(F.min(F.struct("path", "n")).alias("at"))
    return once.withColumn("ordinal", F.row_number().over(Window.partitionBy("relation").orderBy("at", "subject", "object", "qualifier", "tense"))).drop("at")


def named_ends(stated_: DataFrame, names: DataFrame, key: str = "path") -> DataFrame:
    """Statements with their names led to paths of ``names`` (name, target); the note itself is its own. Others are dropped."""
    out = stated_
    for end in ("first", "second"):
        known = names.select(F.col("name").alias("_n"), F.col("target").alias("_t"))
        own = F.col(end).startswith("\x00")
        out = out.withColumn("_n", T.normal_name(F.col(end))).join(known, "_n", "left").withColumn(end, F.when(own, F.substring(F.col(end), F.lit(2), F.length(F.col(end)))).otherwise(F.col("_t"))).drop("_n", "_t").where(F.col(end).isNotNull())
    return out


def hits(edge_table: DataFrame, identities: DataFrame, asked: DataFrame | Request, query: str = "query_id", types: DataFrame | None = None) -> DataFrame:
    """(query, path, ordinal): answers to requests, each of whose seeds must name exactly one path of ``identities`` (name,
    path). A past request takes past edges only, a current one none; a qualifier must agree; with ``types`` (path,
    type) the answer must be of a type that was asked for. A single Request gives (path, ordinal).
    """
    single = isinstance(asked, Request)
    if single:
        r = asked
        asked = edge_table.sparkSession.createDataFrame([(0, r.seed, r.relation, r.direction, list(r.answer), r.qualifier, r.tense)], "query_id int, seed string, relation string, direction string, answer array<string>, qualifier string, tense string")
        query = "query_id"
    seeds = identities.groupBy("name").agg(F.min("path").alias("_seed"), F.max("path").alias("_other")).where("_seed = _other").drop("_other")
    known = asked.join(seeds, F.col("seed") == F.col("name")).select(query, "_seed", "relation", "direction", "answer", F.col("qualifier").alias("_q"), F.col("tense").alias("_t"))
    extra = [c for c in ("qualifier", "tense") if c in edge_table.columns]
    ways = [edge_table.select(F.lit(way).alias("direction"), F.col(own).alias("_seed"), "relation", F.col(far).alias("path"), "ordinal", *extra) for way, own, far in (("out", "subject", "object"), ("in", "object", "subject"))]
    met = known.join(ways[0].unionByName(ways[1]), ["direction", "_seed", "relation"])
    if extra:
        met = met.where((F.col("_q") == "") | (F.col("_q") == F.col("qualifier"))).where(F.when(F.col("_t") == "past", F.col("tense") == "past").when(F.col("_t") == "current", F.col("tense") != "past").otherwise(True))
    if types is not None:
        met = met.join(types.select("path", F.col("type").alias("_a")), "path").where((F.size("answer") == 0) | F.array_contains("answer", F.col("_a")))
    found = met.groupBy(query, "path").agg(F.min("ordinal").alias("ordinal"))
    return found.drop(query) if single else found


def answers_first(ranked: DataFrame, answers: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, score, answer): exact answers (query, key) in front of a ranking (query, key, score), in the order of
    their lexical place and then of their keys, each a millionth of the peak above the next; the rest as it was."""
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    placed = ranked.select(query, key, "score", F.row_number().over(order).alias("_r"))
    asked = answers.select(query, key).distinct()
    peak = asked.select(query).distinct().join(ranked.groupBy(query).agg(F.max("score").alias("peak")), query, "left").withColumn("peak", F.coalesce("peak", F.lit(1.0)))
    front = asked.join(placed.drop("score"), [query, key], "left").join(peak, query)
    n = F.row_number().over(Window.partitionBy(query).orderBy(F.coalesce("_r", F.lit(2**31)), key))
    total = F.count(F.lit(1)).over(Window.partitionBy(query))
    step = F.greatest(F.abs("peak"), F.lit(1.0)) / 1_000_000
    lifted = front.select(query, key, (F.col("peak") + step * (total - n + 1)).alias("score"), F.lit(True).alias("answer"))
    return lifted.unionByName(placed.join(asked, [query, key], "left_anti").select(query, key, "score", F.lit(False).alias("answer")))


def volunteered(scores: DataFrame, eligible: DataFrame, served: DataFrame, query: str, key: str, k: int = 3) -> DataFrame:
    """(query, key, rank): what a cue brings up unasked: eligible notes (query, key) that were not served yet, by score."""
    left = eligible.select(query, key).distinct().join(served.select(query, key), [query, key], "left_anti").join(scores.select(query, key, "score"), [query, key], "left")
    order = Window.partitionBy(query).orderBy(F.coalesce("score", F.lit(0.0)).desc(), key)
    return left.select(query, key, F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= k)
