"""Queries over the event ledger, learning, code memory, merging and transcripts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import fusion, learning, ledger, merging, notebook
from quillmesh.plans import sqltext as S
from quillmesh.session import table


def events(spark, sf_dir):
    """The ledger's view of the event stream: what each event does to which note of which user."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for x in ("view", "recall", "click", "touch", "purchase", "encode", "error", "outcome", "signup", "session-begin")))
    valence = F.when(F.col("event_type") == "error", -F.least(F.lit(1.0), F.col("value") / 100)).otherwise(F.least(F.lit(1.0), F.col("value") / 100))
    return e.select(F.col("event_id").alias("ordinal"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").alias("note"), F.element_at(kind, F.col("event_type")).alias("kind"), valence.alias("valence"))


def usage(spark, sf_dir):
    return ledger.usage(events(spark, sf_dir)).withColumn("affect", F.round("affect", 6))


def priorities(spark, sf_dir):
    u = ledger.usage(events(spark, sf_dir))
    no = F.lit(False)
    return u.select("note", ledger.priority(F.col("recurrence"), F.col("recalls"), F.round("affect", 6), F.lit(0.0), no, no).alias("priority"))


def strongest(spark, sf_dir):
    """The ten notes of highest priority, earlier ones first where equal."""
    best = priorities(spark, sf_dir).orderBy(F.col("priority").desc(), "note").limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("priority").desc(), "note")).cast("long"))  # of ten rows


def recent(spark, sf_dir):
    u = ledger.usage(events(spark, sf_dir)).orderBy(F.col("last").desc()).limit(10)
    return u.select("note", "last")


def dormant(spark, sf_dir):
    p = priorities(spark, sf_dir)
    return p.agg(F.count_if(F.col("priority") < ledger.FLOOR).alias("dormant"), F.count_if(F.col("priority") >= ledger.FLOOR).alias("active"))


def last_touched_12(spark, sf_dir):
    """For every strong outcome of a user, the user's last twelve notes before it."""
    return ledger.captures(events(spark, sf_dir), "user_id")


def sessions_30m(spark, sf_dir):
    s = ledger.sessions(events(spark, sf_dir), "user_id", "ts", "ordinal")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def waste_streak(spark, sf_dir):
    return ledger.waste_streaks(events(spark, sf_dir), "note", "ordinal")


def pin_state(spark, sf_dir):
    """The register of each note: its last kind of event and its value."""
    e = events(spark, sf_dir)
    return ledger.last_value(e, "note", "kind", "ordinal")


def intents_active(spark, sf_dir):
    """Announcements (signups) that still hold at the ledger's end, a day after which they lapse."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    last = e.where("kind = 'session-begin'").groupBy("user_id").agg(F.max("ts").alias("at"))
    return last.crossJoin(F.broadcast(now)).where(F.unix_micros("at") + ledger.INTENT_TTL * 1_000_000 > F.unix_micros("now")).select("user_id", F.unix_micros("at").alias("since"))


def decay_ticks(spark, sf_dir):
    """Ticks that each user's notes have lost since the user's last event, one a day, three at most."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("at")).crossJoin(F.broadcast(now))
    days = F.floor((F.unix_micros("now") - F.unix_micros("at")) / 86_400_000_000)
    return last.select("user_id", F.least(F.lit(3), days).cast("long").alias("ticks"), F.round(F.pow(F.lit(ledger.DECAY), F.least(F.lit(3), days).cast("double")), 6).alias("factor"))


def note_strength(spark, sf_dir):
    return ledger.strengths(events(spark, sf_dir), "user_id")


def debounced_touches(spark, sf_dir):
    e = events(spark, sf_dir).where("kind IN ('touch', 'encode', 'outcome')")
    return ledger.debounced(e, ["user_id", "kind"], F.unix_micros("ts") / 1e6, "ordinal").select("user_id", "kind", "ordinal")


def _daily(spark, sf_dir):
    return events(spark, sf_dir).withColumn("session", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")))


def session_metrics(spark, sf_dir):
    return learning.session_metrics(_daily(spark, sf_dir), "session")


def hit_rate(spark, sf_dir):
    return learning.hit_rate(session_metrics(spark, sf_dir))


def feedback_clusters(spark, sf_dir):
    f = table(spark, sf_dir, "feedback_events").groupBy("event_id").agg(*(F.min_by(c, "received_at").alias(c) for c in ("text", "domain", "polarity", "session_id", "ts")))
    return learning.feedback_clusters(f.withColumnRenamed("session_id", "session")).drop("words")


def _clusters(spark, sf_dir):
    f = table(spark, sf_dir, "feedback_events").groupBy("event_id").agg(*(F.min_by(c, "received_at").alias(c) for c in ("text", "domain", "polarity", "session_id", "ts")))
    return learning.feedback_clusters(f.withColumnRenamed("session_id", "session"))


def _evolution(spark, sf_dir):
    registry = spark.createDataFrame([], "domain string, rule_id string, polarity int, text string, words array<string>, status string, ts double")
    return learning.evolved(_clusters(spark, sf_dir), registry)


def rule_evolution(spark, sf_dir):
    """What all feedback makes of an empty registry of rules."""
    return _evolution(spark, sf_dir).select("domain", "action", "rule_id", "polarity", "count", "sessions", F.size("words").cast("long").alias("n_words"), F.md5("text").alias("digest"))


def rule_pages(spark, sf_dir):
    """The rules of each domain as a page."""
    made = _evolution(spark, sf_dir).where("action <> 'candidate'").groupBy("domain", "rule_id").agg(F.max_by(F.struct("text", "count", "sessions", F.when(F.col("action") == "demoted", "superseded").otherwise("active").alias("status"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("since")), F.struct("ts", "action")).alias("r"))
    return notebook.rule_pages(made.select("domain", "rule_id", "r.*"))


def seen_before(spark, sf_dir):
    """How long ago each user did the same to the same note."""
    e = ledger.last_seen(events(spark, sf_dir), ["user_id", "kind", "note"], "ts", "ordinal")
    return e.where("seen IS NOT NULL").select("ordinal", T.age((F.unix_micros("ts") - F.unix_micros("seen")) / 1_000_000).alias("ago"))


def session_reviews(spark, sf_dir):
    """What a user's days teach: the cue of a day is the title of the note that has the user's number."""
    daily = _daily(spark, sf_dir)
    titles = table(spark, sf_dir, "notes").select(F.col("note_id").alias("user_id"), F.col("title").alias("text"))
    cues = daily.select("session", "user_id").distinct().join(titles, "user_id").select("session", "text")
    none = spark.createDataFrame([], "session string, note string, term string")
    r = learning.reviews(daily, "session", cues, none, none)
    return r.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"), F.count("term").alias("terms"))


def rule_promotion(spark, sf_dir):
    return learning.promoted_rules(feedback_clusters(spark, sf_dir))


def pin_registers(spark, sf_dir):
    """Pins, supersessions and goals as last writers left them: a note's encodes pin it by their value, its errors replace it."""
    e = events(spark, sf_dir)
    kind = F.when(F.col("kind") == "encode", "pin").when(F.col("kind") == "outcome", "supersede").when(F.col("kind") == "recall", "goal")
    said = e.select("note", kind.alias("kind"), (F.col("valence") - 0.5).alias("valence"), "ordinal").where("kind IS NOT NULL")
    return ledger.pins(said).join(ledger.goals(said), "note", "left").select("note", "pinned", "superseded", F.round("weight", 6).alias("goal"))


def feedback_domains(spark, sf_dir):
    """Feedback by domain in one spelling and polarity, deliveries of one event counted once."""
    f = table(spark, sf_dir, "feedback_events").groupBy("event_id").agg(F.min("domain").alias("domain"), F.min("polarity").alias("polarity"), F.min("session_id").alias("session_id"))
    d = F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.lit("general"))
    return f.groupBy(d.alias("domain"), "polarity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


def assoc_learn(spark, sf_dir):
    """What each positive feedback's session should associate with its domain."""
    f = table(spark, sf_dir, "feedback_events").where("polarity > 0 AND text IS NOT NULL").select("event_id", F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.lit("general")).alias("note"), "text").distinct()
    return learning.associations(f, "session_id", "note", F.col("text"))


def personalized_rank(spark, sf_dir):
    """Scored files of each query, reordered by what use says of them."""
    e = table(spark, sf_dir, "code_memory_evidence")
    once = e.groupBy("query_id", "evidence_id").agg(*(F.max_by(c, "logged_at").alias(c) for c in ("base_rank", "strength", "association", "co_use", "wasted")))
    nan = lambda c: F.when(F.isnan(c) | F.col(c).isNull(), None).otherwise(F.col(c)).alias(c)
    hits = once.select("query_id", "evidence_id", F.col("base_rank").alias("rank"), nan("strength"), nan("association"), nan("co_use"), "wasted").where("rank IS NOT NULL")
    return learning.personalized(hits, "query_id", "evidence_id")


def directory_routes(spark, sf_dir):
    """The two folders of each repository that use has made most familiar."""
    e = table(spark, sf_dir, "code_memory_evidence").where("strength >= 0.15 AND NOT isnan(strength)").select("evidence_id", "repository", T.directory(T.clean_path(F.col("path"))).alias("folder"), "strength").distinct()
    f = e.where("folder <> ''").groupBy("repository", "folder").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("strength"), 6).alias("strength"))
    order = Window.partitionBy("repository").orderBy(F.col("n").desc(), F.col("strength").desc(), "folder")
    return f.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 2")


def relation_memory(spark, sf_dir):
    """What arms that found a file say of its folder, each count saturating."""
    x = table(spark, sf_dir, "code_excerpts").select("repository", T.directory(T.clean_path(F.col("path"))).alias("folder"), F.explode("arms").alias("a"))
    n = x.groupBy("repository", "folder", F.col("a.arm").alias("arm")).agg(F.count(F.lit(1)).alias("n"))
    return learning.relation_scores(n, "repository", "folder")


def arm_fusion(spark, sf_dir):
    """Excerpts fused over the arms that found them, per repository."""
    x = table(spark, sf_dir, "code_excerpts").select("repository", "excerpt_id", F.explode("arms").alias("a")).select("repository", "excerpt_id", F.col("a.arm").alias("ranking"), F.col("a.rank").cast("long").alias("rank"))
    weights = {"dependency": 0.5, "exact": 1.0, "bm25f": 1.0}
    return fusion.fused(x, "repository", "excerpt_id", weights, limit=20, unique=True).withColumn("rank", F.col("rank").cast("long"))


def ledger_union(spark, sf_dir):
    """Deliveries of feedback merged by identity."""
    f = table(spark, sf_dir, "feedback_events")
    line = F.concat_ws("|", F.coalesce("domain", F.lit("")), F.col("polarity"), F.coalesce("session_id", F.lit("")), F.coalesce("text", F.lit("")))
    return merging.union_identified(f, "event_id", [F.col("ts")], line).select("event_id", F.md5("line").alias("digest"), "copies", "conflict", F.round("_o0", 3).alias("ts"))


def legacy_union(spark, sf_dir):
    """Texts of documents at their greatest multiplicity in any source."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", F.md5("text").alias("line"))
    return merging.union_legacy(d, "source", "line")


def transcripts(spark, sf_dir):
    return merging.transcript_turns(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "turn", "role", F.md5("text").alias("digest"))


def transcript_episodes(spark, sf_dir):
    turns = merging.transcript_turns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return merging.episodes(turns, "doc_id").select("doc_id", "messages", F.length("body").cast("long").alias("length"), F.md5("body").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        usage, priorities, strongest, recent, dormant, last_touched_12, pin_registers, rule_evolution, rule_pages, seen_before, session_reviews, sessions_30m, waste_streak, pin_state, intents_active, decay_ticks, note_strength, debounced_touches, session_metrics, hit_rate,
        feedback_clusters, rule_promotion, feedback_domains, assoc_learn, personalized_rank, directory_routes, relation_memory, arm_fusion, ledger_union, legacy_union, transcripts, transcript_episodes,
    )
}

_EV = """ev AS (SELECT event_id AS ordinal, ts, user_id, props->>'$.k' AS note, CASE event_type WHEN 'view' THEN 'recall' WHEN 'click' THEN 'touch' WHEN 'purchase' THEN 'encode' WHEN 'error' THEN 'outcome' ELSE 'session-begin' END AS kind,
CASE WHEN event_type = 'error' THEN -least(1.0, value / 100) ELSE least(1.0, value / 100) END AS valence FROM events)"""
_USE = f"WITH {_EV}, us AS (SELECT note, count_if(kind IN ('touch', 'encode'))::BIGINT AS recurrence, count_if(kind = 'recall')::BIGINT AS recalls, round(coalesce(max(CASE WHEN kind IN ('touch', 'encode') THEN abs(valence) END), 0), 6) AS affect, max(ordinal) AS last FROM ev GROUP BY note)"
_PRI = f"{_USE}, pr AS (SELECT note, round(0.1 * least(10, recalls) / 10 + CASE WHEN recurrence > 0 THEN 0.3 + 0.4 * least(10, recurrence) / 10 + 0.3 * least(1.0, affect) ELSE 0 END, 4)::DOUBLE AS priority FROM us)"
_DAY = f"WITH {_EV}, d AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS session FROM ev), n AS (SELECT session, note, count_if(kind = 'recall') > 0 AS s, count_if(kind IN ('touch', 'encode')) > 0 AS u FROM d GROUP BY ALL), sm AS (SELECT session, count_if(s)::BIGINT AS served, count_if(u)::BIGINT AS used, count_if(s AND u)::BIGINT AS hits, count_if(u AND NOT s)::BIGINT AS misses, count_if(s AND NOT u)::BIGINT AS waste FROM n WHERE s OR u GROUP BY session)"
_FOLDER = r"regexp_extract(regexp_replace(replace(path, '\', '/'), '^(\./)+', ''), '^(.*)/[^/]*$', 1)"
_TURNS = r"""tu AS (SELECT doc_id, i - 1 AS turn, regexp_extract(m[i], '^(\w+): ', 1) AS role, regexp_replace(m[i], '^\w+: ', '') AS text FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id,
list_filter(string_split(regexp_replace(chr(10) || chr(10) || coalesce(text, ''), '\n\n(user|assistant|system): ', chr(1) || '\1: ', 'g'), chr(1)), lambda x, j: j > 1) AS m FROM documents)))"""

ORACLE = {
    "usage": f"{_USE} SELECT * FROM us",
    "priorities": f"{_PRI} SELECT * FROM pr",
    "strongest": f"{_PRI} SELECT * FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, note) AS rank FROM pr) WHERE rank <= 10",
    "recent": f"{_USE} SELECT note, last FROM us ORDER BY last DESC LIMIT 10",
    "dormant": f"{_PRI} SELECT count_if(priority < 0.15)::BIGINT AS dormant, count_if(priority >= 0.15)::BIGINT AS active FROM pr",
    "last_touched_12": f"""WITH {_EV}, t AS (SELECT user_id, note, ordinal FROM ev WHERE kind IN ('touch', 'encode')), o AS (SELECT user_id, ordinal AS outcome FROM ev WHERE kind = 'outcome' AND abs(valence) >= 0.5),
l AS (SELECT outcome, note, max(t.ordinal) AS seen FROM o JOIN t ON o.user_id = t.user_id AND t.ordinal < outcome GROUP BY ALL) SELECT * FROM (SELECT outcome, note, row_number() OVER (PARTITION BY outcome ORDER BY seen DESC) AS rank FROM l) WHERE rank <= 12""",
    "sessions_30m": f"""WITH {_EV}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, ordinal)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, ordinal)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS events, min(ordinal) AS first, max(ordinal) AS last FROM s GROUP BY ALL""",
    "waste_streak": f"WITH {_EV}, l AS (SELECT note, coalesce(max(CASE WHEN kind IN ('touch', 'encode') THEN ordinal END), -1) AS used FROM ev GROUP BY note) SELECT note, count_if(kind = 'recall' AND ordinal > used)::BIGINT AS streak FROM ev JOIN l USING (note) GROUP BY note",
    "pin_state": f"WITH {_EV} SELECT note, arg_max(kind, ordinal) AS kind FROM ev GROUP BY note",
    "pin_registers": f"""WITH {_EV}, r AS (SELECT note, arg_max(CASE WHEN kind = 'encode' THEN valence - 0.5 END, CASE WHEN kind = 'encode' THEN ordinal END) AS p, count_if(kind = 'outcome') AS s, arg_max(CASE WHEN kind = 'recall' THEN valence - 0.5 END, CASE WHEN kind = 'recall' THEN ordinal END) AS g FROM ev GROUP BY note)
SELECT note, coalesce(p > 0, false) AS pinned, s > 0 AS superseded, CASE WHEN g > 0 THEN round(least(1.0, g), 6) END AS goal FROM r WHERE p IS NOT NULL OR s > 0""",
    "seen_before": f"""WITH {_EV}, l AS (SELECT ordinal, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, kind, note ORDER BY ordinal))) // 1000000 AS s FROM ev)
SELECT ordinal, CASE WHEN s < 3600 THEN greatest(1, s // 60) || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS ago FROM l WHERE s IS NOT NULL""",
    "session_reviews": f"""{_DAY}, k AS (SELECT d.session, len(t) AS n FROM (SELECT DISTINCT session, user_id FROM d) d JOIN (SELECT note_id, list_distinct({S.terms('title')}) AS t FROM notes) ON note_id = user_id WHERE len(t) >= 2),
o AS (SELECT session, note, CASE WHEN s AND u THEN 'hit' WHEN u THEN 'miss' ELSE 'waste' END AS outcome FROM n WHERE s OR u), m AS (SELECT session, note FROM o WHERE outcome = 'miss' QUALIFY row_number() OVER (PARTITION BY session ORDER BY note) <= 5), w AS (SELECT m.session, least(16, k.n) AS n FROM m JOIN k USING (session))
SELECT outcome, count(*) + CASE WHEN outcome = 'miss' THEN coalesce((SELECT sum(n) FROM w), 0)::BIGINT ELSE 0 END AS n, count(DISTINCT session) AS sessions, CASE WHEN outcome = 'miss' THEN coalesce((SELECT sum(n) FROM w), 0)::BIGINT ELSE 0 END AS terms FROM o GROUP BY outcome""",
    "intents_active": f"WITH {_EV} SELECT user_id, epoch_us(seen) AS since FROM (SELECT user_id, max(ts) AS seen FROM ev WHERE kind = 'session-begin' GROUP BY user_id) WHERE epoch_us(seen) + 86400000000 > (SELECT epoch_us(max(ts)) FROM ev)",
    "decay_ticks": f"WITH {_EV} SELECT user_id, least(3, d)::BIGINT AS ticks, round(power(0.98, least(3, d)), 6) AS factor FROM (SELECT user_id, (((SELECT epoch_us(max(ts)) FROM ev) - epoch_us(max(ts))) // 86400000000) AS d FROM ev GROUP BY user_id)",
    "debounced_touches": f"""WITH RECURSIVE {_EV}, e AS (SELECT user_id, kind, ordinal, epoch_us(ts) / 1e6 AS t FROM ev WHERE kind IN ('touch', 'encode', 'outcome')), nx AS (SELECT a.user_id, a.kind, a.ordinal, arg_min(b.ordinal, (b.t, b.ordinal)) AS next FROM e a JOIN e b ON a.user_id = b.user_id AND a.kind = b.kind AND b.t - a.t >= 60 AND b.t >= a.t GROUP BY ALL),
k AS (SELECT user_id, kind, arg_min(ordinal, (t, ordinal)) AS ordinal FROM e GROUP BY ALL UNION ALL SELECT k.user_id, k.kind, nx.next FROM k JOIN nx ON nx.ordinal = k.ordinal) SELECT * FROM k""",
    "session_metrics": f"{_DAY} SELECT * FROM sm",
    "hit_rate": f"{_DAY} SELECT sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, round(sum(hits) / nullif(sum(hits) + sum(misses), 0), 6) AS rate FROM sm",
    "feedback_domains": "SELECT coalesce(nullif(lower(trim(domain)), ''), 'general') AS domain, polarity, count(*) AS n, count(DISTINCT session_id) AS sessions FROM (SELECT event_id, min(domain) AS domain, min(polarity) AS polarity, min(session_id) AS session_id FROM feedback_events GROUP BY event_id) GROUP BY ALL",
    "assoc_learn": f"""WITH f AS (SELECT DISTINCT event_id, coalesce(session_id, '') AS session_id, coalesce(nullif(lower(trim(domain)), ''), 'general') AS note, text FROM feedback_events WHERE polarity > 0 AND text IS NOT NULL),
t AS (SELECT DISTINCT note, token FROM (SELECT note, unnest(list_distinct({S.terms('text')})) AS token FROM f)), r AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY length(token) DESC, token) AS r FROM t)
SELECT note, string_agg(token, ' ' ORDER BY r) AS tokens, (SELECT least(1.0, count(DISTINCT session_id) * 0.5)::DOUBLE FROM f WHERE f.note = r.note) AS w FROM r WHERE r <= 16 GROUP BY note""",
    "personalized_rank": """WITH o AS (SELECT query_id, evidence_id, arg_max(base_rank, logged_at) AS rank, arg_max(strength, logged_at) AS st, arg_max(association, logged_at) AS a, arg_max(co_use, logged_at) AS c, arg_max(wasted, logged_at) AS w FROM code_memory_evidence GROUP BY ALL),
s AS (SELECT query_id, evidence_id, rank, round(1.0 / rank * least(1.5, 1 + 0.2 * coalesce(CASE WHEN isnan(st) THEN NULL ELSE st END, 0) + 0.2 * coalesce(CASE WHEN isnan(a) THEN NULL ELSE a END, 0) + 0.1 * least(1.0, coalesce(CASE WHEN isnan(c) THEN NULL ELSE c END, 0))) * CASE WHEN coalesce(w, false) THEN 0.8 ELSE 1.0 END, 9)::DOUBLE AS score FROM o WHERE rank IS NOT NULL)
SELECT query_id, evidence_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank = 1 DESC, score DESC, rank, evidence_id) AS position FROM s""",
    "directory_routes": f"""WITH e AS (SELECT DISTINCT evidence_id, repository, {_FOLDER} AS folder, strength FROM code_memory_evidence WHERE strength >= 0.15 AND NOT isnan(strength))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY n DESC, strength DESC, folder) AS rank FROM (SELECT repository, folder, count(*) AS n, round(max(strength), 6) AS strength FROM e WHERE folder <> '' GROUP BY ALL)) WHERE rank <= 2""",
    "relation_memory": f"SELECT repository, folder, round(sum(least(3, n) / 3.0), 6)::DOUBLE AS score FROM (SELECT repository, folder, a.arm AS arm, count(*) AS n FROM (SELECT repository, {_FOLDER} AS folder, unnest(arms) AS a FROM code_excerpts) GROUP BY ALL) GROUP BY ALL",
    "arm_fusion": """WITH x AS (SELECT repository, excerpt_id, a.arm AS arm, a.rank AS rank FROM (SELECT repository, excerpt_id, unnest(arms) AS a FROM code_excerpts))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY score DESC, excerpt_id) AS rank FROM (SELECT repository, excerpt_id, round(sum(CASE arm WHEN 'dependency' THEN 0.5 ELSE 1.0 END::DOUBLE / (60 + rank)), 12) AS score FROM x GROUP BY ALL)) WHERE rank <= 20""",
    "ledger_union": "SELECT event_id, md5(min(l)) AS digest, count(*) AS copies, count(DISTINCT l) > 1 AS conflict, round(min(ts), 3) AS ts FROM (SELECT event_id, ts, coalesce(domain, '') || '|' || polarity || '|' || coalesce(session_id, '') || '|' || coalesce(text, '') AS l FROM feedback_events) GROUP BY event_id",
    "legacy_union": "SELECT line, unnest(range(1, n + 1)) AS occurrence FROM (SELECT line, max(n) AS n FROM (SELECT source, md5(text) AS line, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL) GROUP BY line)",
    "transcripts": f"WITH {_TURNS} SELECT doc_id, turn, role, md5(text) AS digest FROM tu",
    "transcript_episodes": rf"""WITH {_TURNS}, s AS (SELECT doc_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM tu WHERE role = 'user'), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS n FROM s WHERE t <> '' AND NOT starts_with(t, '<') AND NOT starts_with(t, '[Request')),
l AS (SELECT doc_id, n, regexp_replace(CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(left(t, 240), ' [^ ]*$', '') || ' …' END, '(sk-[A-Za-z0-9_-]{{16,}}|ghp_[A-Za-z0-9]{{20,}}|gho_[A-Za-z0-9]{{20,}}|AKIA[A-Z0-9]{{12,}}|xox[bap]-[A-Za-z0-9-]{{10,}}|(?:password|passwd|secret|token|api_key|apikey)\s*[=:]\s*\S+)', '[scrubbed]', 'gi') AS line FROM k WHERE n <= 30)
SELECT doc_id, count(*) AS messages, length(string_agg(line, chr(10) ORDER BY n)) AS length, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM l GROUP BY doc_id""",
}
