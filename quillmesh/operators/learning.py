"""Reflection and learning: served against used, associations, feedback clusters, promoted rules, code memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T

# Fixed values of the learning loop.
OVERLAP, PROMOTE_COUNT, PROMOTE_SESSIONS = 2, 3, 2
STRENGTH_GAIN, ASSOCIATION_GAIN, CO_USE_GAIN, FACTOR_CAP, WASTE_DAMP, WASTE_RUN = 0.2, 0.2, 0.1, 1.5, 0.8, 3
SATURATION = 3


def session_metrics(events: DataFrame, session: str) -> DataFrame:
    """(session, served, used, hits, misses, waste): set sizes of what a session was served and what it used.

    One aggregate per (session, note), one per session; both combine before their shuffle.
    """
    per = events.groupBy(session, "note").agg((F.count_if(F.col("kind") == "recall") > 0).alias("s"), (F.count_if(F.col("kind").isin("touch", "encode")) > 0).alias("u"))
    s, u = F.col("s"), F.col("u")
    return per.where(s | u).groupBy(session).agg(F.count_if(s).alias("served"), F.count_if(u).alias("used"), F.count_if(s & u).alias("hits"), F.count_if(u & ~s).alias("misses"), F.count_if(s & ~u).alias("waste"))


def hit_rate(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.round(F.sum("hits") / F.nullif(F.sum("hits") + F.sum("misses"), F.lit(0)), 6).alias("rate"))


def associations(used: DataFrame, session: str, note: str, cue: Column, limit: int = 16) -> DataFrame:
    """(note, tokens, w): what a session's cue should have found: its longest tokens, half a point per session, at most 1."""
    pairs = _tokens_of(used.select(note, session, cue.alias("_t")), [note, session])
    per = pairs.groupBy(note, "token").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(note).orderBy(F.length("token").desc(), "token"))
    kept = per.withColumn("_r", rank).where(F.col("_r") <= limit).groupBy(note).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "token"))), lambda x: x["token"]), " ").alias("tokens"))
    weight = used.groupBy(note).agg(F.least(F.lit(1.0), F.countDistinct(session) * 0.5).alias("w"))
    return kept.join(weight, note)


def _tokens_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token): the distinct terms of each row's ``_t``, found as the documents' terms are."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*k, token) for *k, t in batch[[*keys, "_t"]].itertuples(index=False, name=None) for token in dict.fromkeys(T.term_list(t))], columns=[*keys, "token"])

    return rows.mapInPandas(work, f"{fields}, token string")


class _Clusters:
    """The clusters of one domain and polarity, first match first; an index by token finds the candidates."""

    def __init__(self) -> None:
        self.made: list[dict] = []
        self.by_token: dict[str, list[int]] = {}

    def add(self, text: str, session: str | None, ts: float) -> None:
        tokens = {t for t in T.term_list(text) if len(t) > 2}
        shared: dict[int, int] = {}
        for t in tokens:
            for i in self.by_token.get(t, ()):
                shared[i] = shared.get(i, 0) + 1
        home = min((i for i, n in shared.items() if n >= OVERLAP), default=None)
        if home is None:
            home = len(self.made)
            self.made.append({"tokens": set(), "count": 0, "sessions": set(), "text": text, "ts": ts})
        c = self.made[home]
        for t in tokens - c["tokens"]:
            self.by_token.setdefault(t, []).append(home)
        c["tokens"] |= tokens
        c["count"] += 1
        if session:
            c["sessions"].add(session)
        if ts >= c["ts"]:
            c["text"], c["ts"] = text, ts


def feedback_clusters(feedback: DataFrame) -> DataFrame:
    """(domain, polarity, cluster, rule_id, count, sessions, tokens, text, ts, words) from (domain, polarity, text, session, ts).

    Feedback joins the first cluster of its domain and polarity with which it shares two tokens, oldest first; the
    freshest text speaks for a cluster. A greedy fold: rows are sorted within partitions and streamed, a task
    holds clusters, never events. Null texts and domains are empty and ``general``.
    """
    rows = feedback.select(F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.lit("general")).alias("domain"), F.when(F.col("polarity") > 0, 1).otherwise(-1).alias("polarity"), F.coalesce("text", F.lit("")).alias("text"), "session", F.coalesce("ts", F.lit(0.0)).alias("ts"))
    ordered = rows.repartition("domain", "polarity").sortWithinPartitions("domain", "polarity", "ts", "text", "session")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, _Clusters()

        def out() -> pd.DataFrame:
            got = []
            for n, c in enumerate(state.made):
                core = ",".join(sorted(c["tokens"])[:6])
                rule = "r-" + hashlib.sha1(f"{at[0]}|{at[1]}|{core}".encode()).hexdigest()[:10]
                got.append((*at, n, rule, c["count"], len(c["sessions"]), len(c["tokens"]), c["text"], c["ts"], sorted(c["tokens"])))
            return pd.DataFrame(got, columns=["domain", "polarity", "cluster", "rule_id", "count", "sessions", "tokens", "text", "ts", "words"])

        for batch in batches:
            for domain, polarity, text, session, ts in batch.itertuples(index=False, name=None):
                if (domain, polarity) != at:
                    if at is not None:
                        yield out()
                    at, state = (domain, polarity), _Clusters()
                state.add(text, session, ts)
        if at is not None:
            yield out()

    return ordered.mapInPandas(fold, "domain string, polarity int, cluster int, rule_id string, count long, sessions long, tokens long, text string, ts double, words array<string>")


def promoted_rules(clusters: DataFrame) -> DataFrame:
    """Clusters confirmed often enough, in more than one session."""
    return clusters.where((F.col("count") >= PROMOTE_COUNT) & (F.col("sessions") >= PROMOTE_SESSIONS))


def evolved(clusters: DataFrame, registry: DataFrame) -> DataFrame:
    """(domain, action, rule_id, polarity, text, count, sessions, words, ts): what the clusters of ``feedback_clusters``
    change in a registry of rules (domain, rule_id, polarity, text, words, status, ts).

    A confirmed cluster is promoted if it is newer than the last word on its ground, the domain's rules with which it
    shares two words; a rule of the other polarity there is demoted first, one of the same stays as it is. Other
    clusters seen twice on ground without an active rule are candidates. Each cluster meets the registry as those
    before it left it, so a domain is one fold; clusters seen once take no part.
    """
    fields = "domain string, action string, rule_id string, polarity int, text string, count long, sessions long, words array<string>, ts double"
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def fold(key: tuple, found: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
        ground = [dict(id=r.rule_id, p=r.polarity, words=set(r.words), ts=r.ts, live=r.status != "superseded", text=r.text) for r in rules.sort_values("rule_id").itertuples()]
        out = []
        for c in found.sort_values(["polarity", "cluster"]).itertuples():
            words = set(c.words)
            near = [g for g in ground if len(g["words"] & words) >= OVERLAP]
            live = next((g for g in near if g["live"]), None)
            row = lambda action, rule, p, text, words, ts: (key[0], action, rule, p, text, c.count, c.sessions, words, ts)  # noqa: B023, E731
            if c.count < PROMOTE_COUNT or c.sessions < PROMOTE_SESSIONS:
                if live is None:
                    out.append(row("candidate", c.rule_id, c.polarity, c.text, list(c.words), c.ts))
                continue
            if near and c.ts <= max(g["ts"] for g in near) or live is not None and live["p"] == c.polarity:
                continue
            if live is not None:
                live["live"], live["ts"] = False, max(live["ts"], c.ts)
                out.append(row("demoted", live["id"], live["p"], live["text"], sorted(live["words"]), c.ts))
            kept = sorted(words)[:12]
            ground.append(dict(id=c.rule_id, p=c.polarity, words=set(kept), ts=c.ts, live=True, text=c.text))
            out.append(row("promoted", c.rule_id, c.polarity, c.text, kept, c.ts))
        return pd.DataFrame(out, columns=names)

    twice = clusters.where("count >= 2").select("domain", "polarity", "cluster", "rule_id", "count", "sessions", "text", "ts", "words")
    held = registry.select("domain", "rule_id", "polarity", "text", "words", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("ts", F.lit(0.0)).alias("ts"))
    return twice.groupBy("domain").cogroup(held.groupBy("domain")).applyInPandas(lambda k, a, b: fold(k, a, b), fields)


def whispers(evolution: DataFrame, shown: int = 3) -> DataFrame:
    """The candidates that are seen most, then latest: what is said before it is settled."""
    return evolution.where("action = 'candidate'").orderBy(F.col("count").desc(), F.col("ts").desc(), "domain", "rule_id").limit(shown)


def reviews(events: DataFrame, session: str, cues: DataFrame, known: DataFrame, reviewed: DataFrame, misses: int = 5) -> DataFrame:
    """(session, note, outcome, term, w): what the sessions not yet ``reviewed`` (session) teach.

    Each note of a session is a hit, a miss or waste. The first ``misses`` missed notes take the words of the session's
    cue (session, text), if it has two or more, at 0.5; a hit that shares two words with what is ``known`` of it
    (note, term) takes them at 0.2. Rows without a term only record the outcome.
    """
    fresh = events.join(reviewed.select(session).distinct(), session, "left_anti")
    per = fresh.groupBy(session, "note").agg((F.count_if(F.col("kind") == "recall") > 0).alias("s"), (F.count_if(F.col("kind").isin("touch", "encode")) > 0).alias("u")).where("s OR u")
    told = per.select(session, "note", F.when(F.col("s") & F.col("u"), "hit").when(F.col("u"), "miss").otherwise("waste").alias("outcome"))
    terms = cues.select(session, T.tokens(F.col("text"), compose=True).alias("_t")).where(F.size("_t") >= 2)
    # The longest words say most, as in ``associations``.
    terms = terms.select(session, F.explode(F.transform(F.slice(F.array_sort(F.transform("_t", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1, 16), lambda x: x["t"])).alias("term"))
    missed = told.where("outcome = 'miss'").withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy("note"))).where(F.col("_r") <= misses).drop("_r")
    learned = missed.join(terms, session).select(session, "note", "outcome", "term", F.lit(0.5).alias("w"))
    hit = told.where("outcome = 'hit'")
    agreed = hit.join(terms, session).join(known.select("note", "term").distinct(), ["note", "term"], "left_semi").groupBy(session, "note").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    firmer = hit.join(agreed.select(session, "note"), [session, "note"], "left_semi").join(terms, session).select(session, "note", "outcome", "term", F.lit(0.2).alias("w"))
    plain = told.select(session, "note", "outcome", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("w"))
    return plain.unionByName(learned).unionByName(firmer)


def code_session(session: str, query: str, served: DataFrame, used: DataFrame, now: float) -> DataFrame:
    """(kind, note, session, ts, cue): the events that a search session over code leaves: what was served, then what was
    used, each once, to be appended."""
    event = lambda df, kind, at: df.select(F.lit(kind).alias("kind"), "note", F.lit(session).alias("session"), F.lit(now + at).alias("ts"), F.lit(query).alias("cue")).distinct()
    return event(served, "recall", 0.0).unionByName(event(used, "touch", 0.001))


def directory_personalized(hits: DataFrame, use: DataFrame, query: str, key: str, folders: int = 2, files: int = 5, weight: float = 0.5, floor: float = 0.15) -> DataFrame:
    """(query, key, rank): a ranking (query, key, folder, rank) fused with the files of the query's ``folders`` most familiar
    folders (query, folder, strength), ``files`` of each, at ``weight``; the first hit stays first."""
    from quillmesh.operators import fusion

    known = use.where(F.col("strength") >= floor)
    known = known.withColumn("_f", F.row_number().over(Window.partitionBy(query).orderBy(F.col("strength").desc(), "folder"))).where(F.col("_f") <= folders)
    own = hits.join(known.select(query, "folder", "_f"), [query, "folder"]).withColumn("_r", F.row_number().over(Window.partitionBy(query, "folder").orderBy("rank", key))).where(F.col("_r") <= files)
    routed = own.select(query, F.lit("folder").alias("ranking"), key, F.row_number().over(Window.partitionBy(query).orderBy("_f", "_r")).alias("rank"))
    base = hits.select(query, F.lit("base").alias("ranking"), key, "rank")
    return fusion.protected(base, base.unionByName(routed), query, key, 1, {"folder": weight})


def personalized(hits: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, score, rank) of (query, key, rank, strength, association, co_use, wasted): the base rank lifted by
    use, by half at most, and damped after waste; the first base result stays first."""
    lift = 1 + STRENGTH_GAIN * F.coalesce("strength", F.lit(0.0)) + ASSOCIATION_GAIN * F.coalesce("association", F.lit(0.0)) + CO_USE_GAIN * F.least(F.lit(1.0), F.coalesce("co_use", F.lit(0.0)))
    score = F.round(1.0 / F.col("rank") * F.least(F.lit(FACTOR_CAP), lift) * F.when(F.coalesce("wasted", F.lit(False)), WASTE_DAMP).otherwise(1.0), 9)
    order = Window.partitionBy(query).orderBy((F.col("rank") == 1).desc(), F.col("score").desc(), "rank", key)
    scored = hits.select(query, key, "rank", score.alias("score"))
    return scored.select(query, key, "score", F.row_number().over(order).cast("long").alias("position"))


def relation_scores(counts: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, score): what past use says of a pair, each count saturating at three."""
    return counts.groupBy(query, key).agg(F.round(F.sum(F.least(F.lit(SATURATION), F.col("n")) / SATURATION), 6).alias("score"))
