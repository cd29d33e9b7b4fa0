"""All queries of the core, by name, with the SQL that checks them.

Every query reads its whole tables. SQL is kept apart from the operators: it says once more, in its own words, what they
compute. Doubles are rounded to six places on both sides, times are given in microseconds.
"""

from __future__ import annotations

import calendar
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import weights as W
from engram.operators import chunks, entries as E, maintain as M, search as S, topics as T, vocabulary as V
from engram.params import DEFAULT as P
from engram.sources.config import gated, unlocked
from engram.sources.tables import table
from engram.streaming import jobs as J

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

AS_OF = calendar.timegm(time.strptime(P.as_of, "%Y-%m-%d %H:%M:%S")) * 1_000_000


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Parts of the SQL.
_BLANKS = "e' \\t\\r\\n' || chr(12288) || chr(160)"


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


_COLUMNS = "content_hash version content tags category source created fragment_type intensity polarity sentiment_label feedback_score entities level valid_until invalid_at corrected_at consumed_by consumed_at".split()
ENTRIES = "entries AS (SELECT key, " + ", ".join(f"max({c}) AS {c}" for c in _COLUMNS) + " FROM memory WHERE key IS NOT NULL GROUP BY key)"
LIVE = ENTRIES + ",\nlive AS (SELECT * FROM entries WHERE invalid_at IS NULL AND valid_until IS NULL AND corrected_at IS NULL AND coalesce(fragment_type, '') <> 'consumed')"


def _tokens(c: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '\p{{Han}}+|(?:[^\P{{L}}\p{{Han}}]|\p{{N}})+'), lambda r: CASE WHEN regexp_matches(r, '^\p{{Han}}{{2,}}$') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END))"


_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def _terms(c: str) -> str:
    return rf"list_filter({_tokens(c)}, lambda t: length(t) >= 2 AND NOT list_contains({_STOPS}, t) AND NOT regexp_full_match(t, '\p{{N}}+'))"


WORDS = LIVE + f",\nwords AS (SELECT DISTINCT key, unnest({_terms('content')}) AS word FROM live),\ndf AS (SELECT word, count(*) AS df FROM words GROUP BY word)"
TOPIC_LOG = f"log AS (SELECT DISTINCT lower({_strip('topic')}) AS topic, ts, coalesce(weight, 1.0) AS weight FROM topic_log WHERE topic IS NOT NULL AND trim(topic) <> '')"


def _sessions(days: int) -> str:
    return f"""{TOPIC_LOG},
steps AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (ORDER BY ts) + INTERVAL {days} DAY THEN 1 ELSE 0 END AS begins FROM log WHERE ts IS NOT NULL),
numbered AS (SELECT ts, sum(begins) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM steps),
spans AS (SELECT session, min(ts) AS first, max(ts) AS last, count(*) AS writes FROM numbered GROUP BY session)"""


def _current(days: int) -> str:
    return f"""{_sessions(days)},
here AS (SELECT * FROM spans WHERE epoch_us(first) < {AS_OF} ORDER BY last DESC LIMIT 1),
current AS (SELECT log.* FROM log, here WHERE ts BETWEEN first AND last AND epoch_us(last) + {days}::BIGINT * 86400000000 > {AS_OF}),
scores AS (SELECT topic, sum(weight::DECIMAL(18, 6))::DOUBLE AS score, max(ts) AS last_seen FROM current GROUP BY topic)"""


_VARIED = "len(list_distinct(string_split(t, ''))) > 1"
KEYWORDS = rf"""occurrences AS (SELECT key, list_concat(list_filter({_terms('content')}, lambda t: {_VARIED}),
  list_filter(list_filter(regexp_extract_all(regexp_replace(lower(coalesce(content, '')), '[^\p{{L}}\p{{N}}_]+', '  ', 'g'), '(?:^| )([a-z]{{3,}})(?: |$)', 1), lambda t: t <> ''), lambda t: NOT list_contains({_STOPS}, t) AND {_VARIED})) AS o FROM live),
placed AS (SELECT key, unnest(o) AS word, generate_subscripts(o, 1) AS pos FROM occurrences), counted AS (SELECT key, word, count(*) AS n, min(pos) AS pos FROM placed GROUP BY key, word),
keywords AS (SELECT key, word, n, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, pos) AS place FROM counted) WHERE place <= 5)"""
ATTENTION = LIVE + f""",
{KEYWORDS},
attention AS (SELECT word AS topic, sum((2.0 + coalesce(intensity, 0.0) * 1.5)::DECIMAL(18, 6))::DOUBLE AS score FROM keywords JOIN live USING (key) WHERE length(word) >= 2 GROUP BY word),
listed AS (SELECT * FROM attention ORDER BY score DESC, topic DESC LIMIT 10)"""
FEEDBACK = "feedback AS (SELECT key, coalesce(sum(delta), 0)::BIGINT AS score FROM (SELECT DISTINCT key, ts, delta FROM feedback_log WHERE key IS NOT NULL) GROUP BY key)"
BM25 = LIVE + f""",
queries AS (SELECT DISTINCT substr(sha256(query), 1, 12) AS qid, query FROM eval_queries WHERE query IS NOT NULL),
terms AS (SELECT DISTINCT qid, query, unnest({_tokens('query')}) AS term FROM queries),
docs AS (SELECT key, {_tokens('content')} AS tokens FROM live WHERE content IS NOT NULL AND length(content) <= 600),
total AS (SELECT count(*) AS n, sum(len(tokens)) / count(*) AS avg FROM docs),
opened AS (SELECT key, len(tokens) AS dl, unnest(tokens) AS term FROM docs),
tf AS (SELECT key, dl, term, count(*) AS tf FROM opened WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
found AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT key, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) AS part FROM tf JOIN found USING (term), total),
scored AS (SELECT qid, key, round(sum(part), 6) AS score FROM parts JOIN terms USING (term) GROUP BY qid, key),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS place FROM scored) WHERE place <= 20)"""
_DECAY = f"CASE WHEN created IS NULL THEN 0.01::DOUBLE ELSE pow(2.0::DOUBLE, -greatest(({AS_OF} - epoch_us(created)) / 86400e6, 0.0) / 60.0) END"
_EMOTION = "1 + least(coalesce(intensity, 0.0), 2.0) * 0.4"


def _feedback(s: str) -> str:
    return f"CASE WHEN {s} > 0 THEN 1 + 0.3 * least({s} / 3.0, 1.0) WHEN {s} < 0 THEN 1 - 0.5 * least(abs({s}) / 3.0, 1.0) ELSE 1.0 END"


RERANK = BM25 + f""",
{_current(7)},
hot AS (SELECT *, coalesce(pow(2.0::DOUBLE, -greatest(({AS_OF} - epoch_us(last_seen)) / 86400e6, 0.0) / 30.0), 0.5) AS weight FROM scores ORDER BY score DESC, topic DESC LIMIT 10),
{ATTENTION[len(LIVE) + 2:]},
rows AS (SELECT b.qid, b.key, b.score, e.* EXCLUDE (key),
    CASE WHEN max(b.score) OVER (PARTITION BY qid) < 0.001 THEN 1.0 ELSE b.score / max(b.score) OVER (PARTITION BY qid) END AS similarity,
    coalesce((SELECT sum(weight) FROM hot WHERE length(topic) >= 2 AND contains(lower(content), topic)), 0) AS hits,
    coalesce((SELECT sum(score) FROM listed WHERE contains(lower(content), topic)), 0) AS matched,
    (SELECT coalesce(sum(score), 0) FROM listed) AS total
  FROM best b JOIN live e USING (key)),
weighted AS (SELECT *, round(similarity, 6) AS w_similarity, round({_DECAY}, 6) AS w_time, round({_EMOTION}, 6) AS w_emotion, round({_feedback('coalesce(feedback_score, 0)')}, 6) AS w_feedback,
    round(CASE WHEN hits >= 3 THEN 1.2 WHEN hits >= 1 THEN 1 + 0.2 * hits / 3 ELSE 1.0 END, 6) AS w_hot,
    round(CASE WHEN total > 0 THEN 1 + 0.5 * least(matched / total, 1.0) ELSE 1.0 END, 6) AS w_attention FROM rows),
combined AS (SELECT *, round(w_similarity * w_time * w_emotion * w_feedback * w_hot * w_attention, 6) AS combined FROM weighted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined DESC, key) AS rank FROM combined)"""


# Tables as the queries use them.
def memory(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return E.entries(table(spark, sf, "memory"), *columns)


def live(spark: SparkSession, sf: str) -> DataFrame:
    return E.live(memory(spark, sf))


def log(spark: SparkSession, sf: str) -> DataFrame:
    return T.writes(table(spark, sf, "topic_log"))


def hot(spark: SparkSession, sf: str) -> list:
    return T.topic_list(T.scores(T.current(log(spark, sf), "all")), P.hot_topics)


def listed(spark: SparkSession, sf: str) -> list:
    return T.topic_list(T.attention(live(spark, sf)), P.hot_topics)


def terms(spark: SparkSession, sf: str) -> DataFrame:
    return S.query_terms(table(spark, sf, "eval_queries"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Text candidates of every evaluation query, with their entries' columns."""
    rows = live(spark, sf)
    found = S.text_search(E.not_noise(rows, P.noise_chars), terms(spark, sf))
    return found.drop("place").join(rows, "key")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return S.rerank(candidates(spark, sf), S.relative(F.col("score")), hot(spark, sf), listed(spark, sf))


# Sources, filters, updates.
@query(f"WITH {LIVE} SELECT key, content_hash, source, epoch_us(created) AS created FROM live")
def live_entries(spark, sf):
    return live(spark, sf).select("key", "content_hash", "source", F.unix_micros("created").alias("created"))


@query(f"WITH {ENTRIES} SELECT key, content, tags, category, source, epoch_us(created) AS created, fragment_type, sentiment_label, feedback_score, entities, level FROM entries")
def full_scan(spark, sf):
    names = "content tags category source created fragment_type sentiment_label feedback_score entities level".split()
    return memory(spark, sf, *names).select("key", *names).withColumn("created", F.unix_micros("created"))


@query(f"WITH {LIVE}, v AS (SELECT min(key) AS key FROM live) SELECT key, content_hash, level FROM live JOIN v USING (key)")
def point_lookup(spark, sf):
    raw = table(spark, sf, "memory")
    wanted = E.live(E.entries(raw, "invalid_at", "valid_until", "corrected_at", "fragment_type")).agg(F.min("key")).first()[0]
    return E.live(E.lookup(raw, [wanted] if wanted else [])).select("key", "content_hash", "level")


@query(f"WITH {LIVE} SELECT key FROM live WHERE list_has_any(list_transform(tags, lambda t: {_strip('t')}), ['agent:desk-2', 'shared'])")
def agent_scope(spark, sf):
    return live(spark, sf).where(E.visible_to(F.col("tags"), "desk-2")).select("key")


@query(f"WITH {LIVE} SELECT key FROM live WHERE list_has_any(list_transform(tags, lambda t: {_strip('t')}), ['auto-distill', 'cobalt-app'])")
def tag_filter(spark, sf):
    return live(spark, sf).where(E.tagged(F.col("tags"), ["auto-distill", "cobalt-app"])).select("key")


@query(f"WITH {LIVE} SELECT key, list_append(list_filter(list_transform(coalesce(tags, []), lambda t: {_strip('t')}), lambda t: t IS NOT NULL AND t <> '' AND NOT starts_with(t, 'agent:')), 'agent:main') AS tags FROM live")
def stored_tags(spark, sf):
    return live(spark, sf).select("key", E.stored_tags(F.col("tags"), "main").alias("tags"))


#: Trivial turns for which nothing is looked up.
SKIP = ("好", "可以", "嗯", "ok", "好的", "继续", "thanks", "yes")


@query(f"SELECT content, count(*) AS n FROM messages WHERE content IS NOT NULL AND length({_strip('content')}) >= 2 AND lower({_strip('content')}) NOT IN ('" + "', '".join(SKIP) + "') GROUP BY content")
def skip_gate(spark, sf):
    patterns = spark.createDataFrame([(p,) for p in SKIP], "pattern string")
    told = table(spark, sf, "messages").where("content IS NOT NULL").select(F.col("content").alias("query"))
    return gated(told, patterns, P.skip_least).groupBy(F.col("query").alias("content")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BM25}, asking AS (SELECT * FROM (VALUES ('desk-1'), ('desk-2'), ('desk-3')) AS t(agent)), locks AS (SELECT * FROM (VALUES ('desk-1'), ('desk-3')) AS t(agent)) SELECT agent, qid, key, place FROM best, asking WHERE agent NOT IN (SELECT agent FROM locks) AND place <= 5")
def locked_search(spark, sf):
    """What three agents get for the evaluation queries while a workflow has locked two of them."""
    asking, locks = (spark.createDataFrame([(a,) for a in names], "agent string") for names in (("desk-1", "desk-2", "desk-3"), ("desk-1", "desk-3")))
    asked = unlocked(terms(spark, sf).withColumn("agent", F.explode(F.array(*[F.lit(r.agent) for r in asking.collect()]))), locks)
    found = S.text_search(E.not_noise(live(spark, sf), P.noise_chars), asked.withColumn("qid", F.concat_ws("|", "agent", "qid")), most=P.final_limit)
    parts = F.split("qid", r"\|")
    return found.select(parts[0].alias("agent"), parts[1].alias("qid"), "key", "place")


@query(f"""WITH {ENTRIES} SELECT key, content_hash, row_number() OVER w AS number, epoch_us(lead(created) OVER w) AS superseded_at, lead(key) OVER w IS NULL AS last
FROM entries WINDOW w AS (PARTITION BY content_hash ORDER BY created NULLS FIRST, key)""")
def version_chain(spark, sf):
    rows = E.versions(memory(spark, sf, "content_hash", "created"))
    return rows.select("key", "content_hash", "number", F.unix_micros("superseded_at").alias("superseded_at"), "last")


@query(f"""WITH {ENTRIES}, {FEEDBACK} SELECT key, coalesce(f.score, e.feedback_score) AS feedback_score, CASE WHEN f.score <= -3 THEN '{P.as_of}' ELSE NULL END AS invalid_at
FROM entries e LEFT JOIN feedback f USING (key)""")
def updated_entries(spark, sf):
    rows = memory(spark, sf, "feedback_score").withColumn("invalid_at", F.lit(None).cast("string"))
    totals = E.feedback_totals(table(spark, sf, "feedback_log"))
    now = F.lit(P.as_of).cast("timestamp")
    updates = totals.select("key", now.alias("ts"), F.lit("feedback_score").alias("column"), F.col("score").cast("string").alias("value"))
    updates = updates.unionByName(totals.where("score <= -3").select("key", now.alias("ts"), F.lit("invalid_at").alias("column"), F.lit(P.as_of).alias("value")))
    return E.with_updates(rows, updates, "feedback_score", "invalid_at")


@query(f"WITH {FEEDBACK} SELECT key, score FROM feedback")
def feedback_totals(spark, sf):
    return E.feedback_totals(table(spark, sf, "feedback_log"))


@query(f"WITH {ENTRIES}, gone AS (SELECT DISTINCT consumed_by AS key FROM memory WHERE consumed_by IS NOT NULL) SELECT key FROM entries WHERE key NOT IN (SELECT key FROM gone)")
def deleted_entries(spark, sf):
    gone = table(spark, sf, "memory").where("consumed_by IS NOT NULL").select(F.col("consumed_by").alias("key"))
    return E.without(memory(spark, sf, "content_hash"), gone).select("key")


@query("SELECT id, json_extract_string(content, '$.log') AS log FROM (SELECT id, max(content) AS content FROM messages WHERE role = 'tool' AND id IS NOT NULL GROUP BY id) WHERE starts_with(content, '{') AND json_valid(content)")
def tool_logs(spark, sf):
    rows = table(spark, sf, "messages").where("role = 'tool' AND id IS NOT NULL").groupBy("id").agg(F.max("content").alias("content"))
    return rows.where(F.col("content").startswith("{") & F.get_json_object("content", "$").isNotNull()).select("id", F.get_json_object("content", "$.log").alias("log"))


# Factors.
@query(f"WITH {ENTRIES} SELECT key, round({_DECAY}, 6) AS weight FROM entries")
def time_decay(spark, sf):
    return memory(spark, sf, "created").select("key", F.round(W.decay(F.col("created")), 6).alias("weight"))


@query(f"WITH {FEEDBACK} SELECT key, score, round({_feedback('score')}, 6) AS weight FROM feedback")
def feedback_weight(spark, sf):
    return E.feedback_totals(table(spark, sf, "feedback_log")).select("key", "score", F.round(W.feedback_weight(F.col("score")), 6).alias("weight"))


@query(f"WITH {ENTRIES} SELECT key, round({_EMOTION}, 6) AS weight FROM entries")
def emotion_weight(spark, sf):
    return memory(spark, sf, "intensity").select("key", F.round(W.emotion_weight(F.col("intensity")), 6).alias("weight"))


@query(f"""WITH {_current(7)}, {LIVE},
hot AS (SELECT *, coalesce(pow(2.0::DOUBLE, -greatest(({AS_OF} - epoch_us(last_seen)) / 86400e6, 0.0) / 30.0), 0.5) AS weight FROM scores ORDER BY score DESC, topic DESC LIMIT 10),
h AS (SELECT key, coalesce((SELECT sum(weight) FROM hot WHERE length(topic) >= 2 AND contains(lower(content), topic)), 0) AS hits FROM live)
SELECT key, round(hits, 6) AS hits, round(CASE WHEN hits >= 3 THEN 1.2 WHEN hits >= 1 THEN 1 + 0.2 * hits / 3 ELSE 1.0 END, 6) AS weight FROM h""")
def hot_topic_weight(spark, sf):
    hits = T.hot_hits(F.col("content"), hot(spark, sf))
    return live(spark, sf).select("key", F.round(hits, 6).alias("hits"), F.round(W.hot_weight(hits), 6).alias("weight"))


@query(f"""WITH {ATTENTION} SELECT key, round(1 + 0.5 * least(coalesce((SELECT sum(score) FROM listed WHERE contains(lower(content), topic)), 0) / (SELECT sum(score) FROM listed), 1.0), 6) AS weight FROM live""")
def attention_weight(spark, sf):
    matched, total = T.matched_attention(F.col("content"), listed(spark, sf))
    return live(spark, sf).select("key", F.round(W.attention_weight(matched, F.lit(total)), 6).alias("weight"))


# Retrieval.
@query(f"WITH {BM25} SELECT qid, key, score, place FROM best")
def bm25_search(spark, sf):
    rows = E.not_noise(live(spark, sf), P.noise_chars)
    return S.text_search(rows, terms(spark, sf)).select("qid", "key", "score", "place")


@query(f"WITH {RERANK} SELECT qid, key, w_similarity, w_time, w_emotion, w_feedback, w_hot, w_attention, combined, rank FROM ranked WHERE rank <= 5")
def bm25_rerank(spark, sf):
    rows = ranked(spark, sf).where(F.col("place") <= P.final_limit)
    return rows.select("qid", "key", *[f"w_{n}" for n in ("similarity", "time", "emotion", "feedback", "hot", "attention")], "combined", F.col("place").alias("rank"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT qid, id, round(1 - list_cosine_similarity(q.v, b.v), 6) AS distance FROM q JOIN b ON qid <> id)
SELECT qid, id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS place FROM d) WHERE place <= 10""")
def knn_search(spark, sf):
    base = S.usable(table(spark, sf, "embeddings"), "vec_id", "embedding", 64)
    return S.nearest(base, base.where("id % 20 = 0").withColumnRenamed("id", "qid"), P.knn_limit, "long")


_KNN = f"""{BM25},
usable AS (SELECT key, max(embedding)::DOUBLE[] AS v FROM vectors WHERE model = 'mini-embed-64' AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY key),
base AS (SELECT key, v FROM usable JOIN live USING (key)),
asked AS (SELECT qid, v FROM (SELECT b.qid, u.v, row_number() OVER (PARTITION BY b.qid ORDER BY b.place) AS r FROM best b JOIN base u USING (key)) WHERE r = 1),
near AS (SELECT qid, key, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM asked a, base b),
close AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, key) AS place FROM near) WHERE place <= 10)"""


def _close(spark, sf, rows: DataFrame) -> DataFrame:
    """The nearest entries of each evaluation query, whose vector is that of its best text hit that has one."""
    v = S.usable(table(spark, sf, "vectors").where("model = 'mini-embed-64'"), "key", "embedding", 64)
    base = rows.select(F.col("key").alias("id")).join(v, "id")
    hits = S.text_search(E.not_noise(rows, P.noise_chars), terms(spark, sf)).join(base, F.col("key") == F.col("id"))
    asked = S.best(hits, ["qid"], [F.asc("place")], 1, "r").select("qid", "v")
    return S.nearest(base, asked, P.knn_limit).select("qid", F.col("id").alias("key"), "distance", "place")


@query(f"WITH {_KNN} SELECT qid, key, distance, round(1 - greatest(0, least(1, distance / 2)), 7) AS similarity, place FROM close")
def vector_search(spark, sf):
    return _close(spark, sf, live(spark, sf)).select("qid", "key", "distance", F.round(W.similarity_of_distance(F.col("distance")), 7).alias("similarity"), "place")


@query(f"""WITH {_KNN},
lists AS (SELECT qid, content, 1 AS list, place, key FROM best JOIN live USING (key) WHERE place <= 5 UNION ALL SELECT qid, content, 2, place, key FROM close JOIN live USING (key) WHERE place <= 5),
fused AS (SELECT qid, coalesce(content, '') AS item, round(sum(1.0::DOUBLE / (60 + place)), 9) AS fused, min(struct_pack(list, place, key)) AS first FROM lists GROUP BY ALL)
SELECT qid, first.key AS key, fused, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, first, item) AS place FROM fused) WHERE place <= 5""")
def rrf_hybrid(spark, sf):
    rows = live(spark, sf)
    said = rows.select("key", F.coalesce("content", F.lit("")).alias("item"))
    first = S.text_search(E.not_noise(rows, P.noise_chars), terms(spark, sf), most=P.final_limit).select("qid", "key", F.lit(1).alias("list"), "place")
    second = _close(spark, sf, rows).where(F.col("place") <= P.final_limit).select("qid", "key", F.lit(2).alias("list"), "place")
    return S.fuse(first.unionByName(second).join(said, "key"), P.rrf_k, P.final_limit).select("qid", "key", "fused", "place")


@query(f"""WITH {RERANK}, lines AS (SELECT qid, rank, '[' || rank || '] ' || coalesce(content, '') || chr(10) || '  ' ||
  CASE WHEN sentiment_label LIKE '%positive' THEN '+' WHEN sentiment_label LIKE '%negative' THEN '-' ELSE '=' END || ' ' || coalesce(array_to_string(tags, ','), '') || ' ' || printf('%.2f', round(combined, 2)) AS line FROM ranked WHERE rank <= 5)
SELECT qid, '<memory>' || chr(10) || string_agg(line, chr(10) ORDER BY rank) || chr(10) || '</memory>' AS block FROM lines GROUP BY qid""")
def context_blocks(spark, sf):
    rows = ranked(spark, sf).where(F.col("place") <= P.final_limit)
    return S.render(rows.withColumn("combined", F.round("combined", 2)))


@query(f"""WITH {RERANK}, hits AS (SELECT qid, max(CASE WHEN contains(lower(content), lower(word)) THEN 1 ELSE 0 END) AS hit FROM ranked JOIN (SELECT substr(sha256(query), 1, 12) AS qid, unnest(expected) AS word FROM eval_queries) USING (qid) WHERE rank <= 5 GROUP BY qid)
SELECT count(*) AS queries, sum(coalesce(hit, 0))::BIGINT AS hits, round(avg(coalesce(hit, 0)), 6) AS rate, avg(coalesce(hit, 0)) >= 0.7 AS passed FROM (SELECT DISTINCT qid FROM queries) LEFT JOIN hits USING (qid)""")
def eval_hit_rate(spark, sf):
    expected = table(spark, sf, "eval_queries").select(X.content_hash(F.col("query")).alias("qid"), "expected")
    hits = S.evaluate(ranked(spark, sf).where(F.col("place") <= P.evaluation_top), expected)
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("rate"), (F.avg("hit") >= P.evaluation_pass).alias("passed"))


_SYNONYMS = f"""{WORDS},
frequent AS (SELECT * FROM df WHERE df >= 10), kept AS (SELECT key, word FROM words JOIN frequent USING (word)),
pairs AS (SELECT a.word AS word_a, b.word AS word_b, count(*) AS n FROM kept a JOIN kept b ON a.key = b.key AND a.word < b.word GROUP BY 1, 2),
synonyms AS (SELECT word_a, word_b, n, round(n / (a.df + b.df - n)::DOUBLE, 6) AS jaccard FROM pairs JOIN frequent a ON a.word = word_a JOIN frequent b ON b.word = word_b
             WHERE round(n / (a.df + b.df - n)::DOUBLE, 6) >= 0.5 OR n >= 3)"""


@query(f"WITH {_SYNONYMS} SELECT word_a, word_b, n, jaccard FROM synonyms")
def synonym_discovery(spark, sf):
    return V.synonyms(live(spark, sf))


#: Synonyms given by hand; a term that has some keeps just those.
MANUAL = (("gateway", "proxy"), ("backup", "snapshot"), ("Backup", "archive"), ("parser", "reader"), ("deployment", "rollout"), ("队列", "排队"), ("日志", "记录"))
_MANUAL = "manual AS (SELECT DISTINCT lower(term) AS term, lower(synonym) AS synonym FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MANUAL) + ") AS t(term, synonym))"
_EDGES = _SYNONYMS + f""", close AS (SELECT * FROM synonyms WHERE jaccard >= 0.5), {_MANUAL},
edges AS (SELECT term, synonym FROM manual UNION SELECT * FROM (SELECT word_a AS term, word_b AS synonym FROM close UNION SELECT word_b, word_a FROM close) WHERE term NOT IN (SELECT term FROM manual))"""


def _edges(spark, sf) -> DataFrame:
    return V.merged_synonyms(_close_words(spark, sf), spark.createDataFrame(list(MANUAL), "term string, synonym string"))


def _close_words(spark, sf) -> DataFrame:
    return V.synonyms(live(spark, sf)).where("jaccard >= 0.5")


@query(f"""WITH {_EDGES}
SELECT term, '[' || string_agg('"' || synonym || '"', ',' ORDER BY synonym) || ']' AS synonyms FROM edges GROUP BY term""")
def synonym_table(spark, sf):
    return V.synonym_rows(_edges(spark, sf))


@query(f"""WITH {_EDGES},
queries AS (SELECT DISTINCT substr(sha256(query), 1, 12) AS qid, query FROM eval_queries WHERE query IS NOT NULL), terms AS (SELECT DISTINCT qid, query, unnest({_tokens('query')}) AS term FROM queries)
SELECT qid, term FROM terms UNION SELECT qid, synonym FROM terms JOIN edges USING (term)""")
def synonym_expand(spark, sf):
    return S.expand_terms(terms(spark, sf), _edges(spark, sf)).select("qid", "term")


_ENTITIES = f"""{LIVE},
named AS (SELECT DISTINCT key, lower({_strip('e')}) AS entity FROM (SELECT key, unnest(entities) AS e FROM live) WHERE e IS NOT NULL AND {_strip('e')} <> ''),
pairs AS (SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n FROM named a JOIN named b ON a.key = b.key AND a.entity < b.entity GROUP BY 1, 2)"""


@query(f"WITH {_ENTITIES} SELECT entity_a, entity_b, n FROM pairs")
def entity_cooccurrence(spark, sf):
    return V.entity_pairs(live(spark, sf))


@query(f"""WITH {_ENTITIES}, queries AS (SELECT DISTINCT substr(sha256(query), 1, 12) AS qid, query FROM eval_queries WHERE query IS NOT NULL),
own AS (SELECT DISTINCT qid, lower({_strip('e')}) AS term FROM (SELECT substr(sha256(query), 1, 12) AS qid, unnest(expected) AS e FROM eval_queries) WHERE e IS NOT NULL),
both_ways AS (SELECT entity_a AS term, entity_b AS other, n FROM pairs WHERE n >= 2 UNION ALL SELECT entity_b, entity_a, n FROM pairs WHERE n >= 2),
found AS (SELECT qid, other, max(n) AS n FROM own JOIN both_ways USING (term) GROUP BY qid, other),
fresh AS (SELECT * FROM found WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.qid = found.qid AND own.term = found.other))
SELECT qid, other AS entity, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, other) AS place FROM fresh) WHERE place <= 3""")
def cooc_expand(spark, sf):
    own = table(spark, sf, "eval_queries").select(X.content_hash(F.col("query")).alias("qid"), "query", F.explode("expected").alias("e")).where("e IS NOT NULL")
    own = own.select("qid", "query", F.lower(F.trim("e")).alias("term")).distinct()
    return S.together_expansion(own, V.entity_pairs(live(spark, sf))).select("qid", "entity", "n")


@query(f"""WITH {ENTRIES}, named AS (SELECT DISTINCT lower({_strip('e')}) AS entity, key, created FROM (SELECT key, created, unnest(entities) AS e FROM entries WHERE content IS NOT NULL AND trim(content) <> '') WHERE e IS NOT NULL AND {_strip('e')} <> '')
SELECT entity, key, epoch_us(created) AS created, place FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY created DESC NULLS LAST, key) AS place FROM named) WHERE place <= 20""")
def entity_timeline(spark, sf):
    rows = S.best(E.timeline(memory(spark, sf)), ["entity"], [F.desc_nulls_last("created"), F.asc("key")], 20)
    return rows.select("entity", "key", F.unix_micros("created").alias("created"), "place")


# Topics.
@query(f"WITH {_current(7)} SELECT topic, round(score, 1) AS score FROM scores ORDER BY scores.score DESC, topic DESC LIMIT 30")
def hot_topics(spark, sf):
    return T.top(T.scores(T.current(log(spark, sf), "all")), 30).select("topic", F.round("score", 1).alias("score"))


@query(f"WITH {_current(14)} SELECT topic, score, epoch_us(last_seen) AS last_seen FROM scores")
def weekly_topics(spark, sf):
    return T.scores(T.current(log(spark, sf), "weekly")).select("topic", "score", F.unix_micros("last_seen").alias("last_seen"))


@query(f"WITH {_current(2)} SELECT topic, score > 1.0 AS is_hot FROM scores")
def hot_keyword_test(spark, sf):
    return T.scores(T.current(log(spark, sf), "daily")).select("topic", (F.col("score") > 1.0).alias("is_hot"))


@query(f"WITH {TOPIC_LOG} SELECT topic, epoch_us(max(ts)) AS last_seen FROM log GROUP BY topic")
def topic_last_seen(spark, sf):
    return log(spark, sf).groupBy("topic").agg(F.unix_micros(F.max("ts")).alias("last_seen"))


@query(" UNION ALL ".join(f"(WITH {_sessions(d)} SELECT '{n}' AS period, epoch_us(first) AS first, epoch_us(last) AS last, writes::BIGINT AS writes FROM spans)" for n, d in T.LIFETIMES.items()))
def topic_sessions(spark, sf):
    rows, out = log(spark, sf), None
    for name, days in T.LIFETIMES.items():
        one = T.sessions(rows, days).select(F.lit(name).alias("period"), F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "writes")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {ATTENTION} SELECT topic, score FROM attention")
def attention_scores(spark, sf):
    return T.attention(live(spark, sf))


@query(f"WITH {ATTENTION} SELECT topic, round(score, 1) AS score FROM listed")
def top_attention(spark, sf):
    return T.top(T.attention(live(spark, sf)), 10).select("topic", F.round("score", 1).alias("score"))


# Vocabulary.
@query(f"WITH {WORDS} SELECT word, df FROM df")
def doc_frequency(spark, sf):
    return V.document_frequency(live(spark, sf))


@query(f"""WITH {_EDGES}, known AS (SELECT term AS word FROM edges UNION SELECT synonym FROM edges),
merged AS (SELECT word, greatest(coalesce(df, 0), CASE WHEN k.word IS NULL THEN 0 ELSE 3 END) AS freq FROM df FULL JOIN known k USING (word))
SELECT word || ' ' || freq || ' nz' AS value FROM merged WHERE freq >= 2""")
def dictionary_terms(spark, sf):
    return V.dictionary_lines(V.dictionary(live(spark, sf), _edges(spark, sf)))


@query(f"WITH {LIVE}, {KEYWORDS} SELECT key, word, n, place FROM keywords")
def keywords_top5(spark, sf):
    return V.keywords(live(spark, sf))


# Text functions.
def _feeling_sql() -> str:
    def one(words: dict[str, float], turned: bool) -> str:
        parts = []
        for w, weight in words.items():
            at = f"instr(low, '{w}')"
            before = f"substr(low, greatest({at} - 4, 1), {at} - greatest({at} - 4, 1))"
            negated = " OR ".join(f"contains({before}, '{n.replace(chr(39), chr(39) * 2)}')" for n in X.NEGATORS)
            parts.append(f"CASE WHEN {at} > 0 AND {'' if turned else 'NOT'} ({negated}) THEN {weight * (0.5 if turned else 1)}::DOUBLE ELSE 0 END")
        return "(" + " + ".join(parts) + ")"

    return f"s AS (SELECT key, {one(X.POSITIVE, False)} + {one(X.NEGATIVE, True)} AS p, {one(X.NEGATIVE, False)} + {one(X.POSITIVE, True)} AS n FROM (SELECT key, lower(coalesce(content, '')) AS low FROM live))"


@query(f"WITH {LIVE}, {_feeling_sql()}, v AS (SELECT key, round(greatest(-1.0, least(1.0, (p - n) / greatest(p + n, 0.1::DOUBLE))), 6) AS polarity FROM s) SELECT key, polarity, CASE WHEN polarity > 0.15 THEN 'positive' WHEN polarity < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM v")
def sentiment_polarity(spark, sf):
    rows = live(spark, sf).select("key", X.sentiment(F.col("content")).alias("polarity"))
    return rows.withColumn("label", X.sentiment_label(F.col("polarity")))


@query()
def emotion_intensity(spark, sf):
    rows = live(spark, sf).select("key", "content", X.intensity(F.col("content")).alias("intensity"))
    return rows.select("key", "intensity", X.intensity_label(F.col("content"), F.col("intensity")).alias("label"))


@query()
def extracted_entities(spark, sf):
    return live(spark, sf).select("key", X.entities(F.col("content")).alias("entities"))


@query(f"WITH {ENTRIES} SELECT key, substr(sha256(content), 1, 12) AS hash, md5(content) AS cache_key FROM entries WHERE content IS NOT NULL")
def content_hashes(spark, sf):
    return memory(spark, sf, "content").where("content IS NOT NULL").select("key", X.content_hash(F.col("content")).alias("hash"), F.md5("content").alias("cache_key"))


_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query(f"""WITH {ENTRIES}, v AS (SELECT key, content_hash, created, lower(coalesce(content, '')) AS c, lag(lower(coalesce(content, ''))) OVER w AS b, lag(key) OVER w AS previous FROM entries WINDOW w AS (PARTITION BY source ORDER BY created NULLS FIRST, key)),
g AS (SELECT key, previous, {_GRAMS.format('c')} AS x, {_GRAMS.format('b')} AS y FROM v WHERE previous IS NOT NULL)
SELECT key, previous, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END, 6) AS similarity FROM g""")
def ngram_pairs(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("source").orderBy(F.asc_nulls_first("created"), "key")
    low = F.lower(F.coalesce("content", F.lit("")))
    rows = memory(spark, sf, "content", "source", "created").select("key", low.alias("c"), F.lag(low).over(w).alias("b"), F.lag("key").over(w).alias("previous")).where("previous IS NOT NULL")
    return rows.select("key", "previous", F.round(X.jaccard(X.ngrams(F.col("c")), X.ngrams(F.col("b"))), 6).alias("similarity"))


@query()
def text_chunks(spark, sf):
    return chunks.chunk_rows(memory(spark, sf, "content"), "key", "content")


# Maintenance.
_ELIGIBLE = WORDS.replace("FROM live)", "FROM eligible)").replace(LIVE, LIVE + ",\neligible AS (SELECT * FROM entries WHERE invalid_at IS NULL AND coalesce(feedback_score, 0) <> -1 AND length(content) >= 4)")
_CANDIDATES = _ELIGIBLE + """,
total AS (SELECT count(*) AS n FROM eligible),
asked AS (SELECT key, word, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT key, word, df, row_number() OVER (PARTITION BY key ORDER BY df, word) AS r FROM words JOIN df USING (word) WHERE df > 1), total WHERE r <= 8),
scored AS (SELECT a.key, b.key AS other, round(sum(idf), 6) AS raw FROM asked a JOIN words b ON a.word = b.word AND a.key <> b.key GROUP BY 1, 2),
candidates AS (SELECT key, other, raw FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY raw DESC, other) AS r FROM scored) WHERE r <= 20)"""
_J = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE END"
_SCORES = _CANDIDATES + f""",
parts AS (SELECT key, created, list_distinct({_terms('content')}) AS w, list_distinct(list_filter(list_transform(coalesce(entities, []), lambda e: lower({_strip('e')})), lambda e: e IS NOT NULL AND e <> '')) AS e, {_GRAMS.format('lower(content)')} AS g, coalesce(intensity, 0.0) AS s FROM eligible),
compared AS (SELECT c.key, c.other, a.created, b.created AS other_created, {_J.format('a.w', 'b.w')} AS jw, {_J.format('a.e', 'b.e')} AS je, {_J.format('a.g', 'b.g')} AS jg, least(raw / 20, 1.0) AS t, abs(a.s - b.s) AS gap, a.s AS sa, b.s AS sb, len(a.e) AS ea, len(b.e) AS eb FROM candidates c JOIN parts a ON a.key = c.key JOIN parts b ON b.key = c.other),
fused AS (SELECT *, CASE WHEN abs(sa) > 0.3 OR abs(sb) > 0.3 THEN CASE WHEN gap > 0.8 THEN 0 ELSE 0.4 * jw + 0.3 * (1 - gap) + 0.2 * t + 0.1 * jg END ELSE 0.4 * je + 0.3 * t + 0.2 * jw + 0.1 * jg END AS f FROM compared),
final AS (SELECT *, round(greatest(0, least(1, CASE WHEN ea > 0 AND eb > 0 AND je = 0 THEN f * 0.5 ELSE f END)), 6) AS score FROM fused)"""


def eligible(spark, sf) -> DataFrame:
    return M.dedup_eligible(memory(spark, sf))


@query(f"WITH {_CANDIDATES} SELECT key, other, raw FROM candidates")
def dedup_candidates(spark, sf):
    return M.dedup_candidates(eligible(spark, sf))


@query(f"WITH {_SCORES} SELECT key, other, score FROM final")
def dedup_scores(spark, sf):
    return M.dedup_scores(eligible(spark, sf))


# All pairs that share a word are scored, without a limit of candidates; bigrams only where they can still decide.
_MARKS = _ELIGIBLE + f""",
total AS (SELECT count(*) AS n FROM eligible),
asked AS (SELECT key, word, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT key, word, df, row_number() OVER (PARTITION BY key ORDER BY df, word) AS r FROM words JOIN df USING (word) WHERE df > 1), total WHERE r <= 8),
text_scores AS (SELECT a.key, b.key AS other, least(round(sum(idf), 6) / 20, 1.0) AS t FROM asked a JOIN words b ON a.word = b.word AND a.key <> b.key GROUP BY 1, 2),
together AS (SELECT a.key, b.key AS other, count(*) AS n FROM words a JOIN words b ON a.word = b.word AND a.key <> b.key GROUP BY 1, 2),
parts AS (SELECT key, coalesce(created, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS since, len(list_distinct({_terms('content')})) AS w, list_distinct(list_filter(list_transform(coalesce(entities, []), lambda e: lower({_strip('e')})), lambda e: e IS NOT NULL AND e <> '')) AS e, {_GRAMS.format('lower(content)')} AS g, coalesce(intensity, 0.0) AS s FROM eligible),
compared AS (SELECT p.key, p.other, a.since, b.since AS other_since, p.n / (a.w + b.w - p.n)::DOUBLE AS jw, {_J.format('a.e', 'b.e')} AS je, a.g AS ga, b.g AS gb, coalesce(x.t, 0.0) AS t, abs(a.s - b.s) AS gap, abs(a.s) > 0.3 OR abs(b.s) > 0.3 AS felt, len(a.e) > 0 AND len(b.e) > 0 AS named
  FROM together p JOIN parts a ON a.key = p.key JOIN parts b ON b.key = p.other LEFT JOIN text_scores x ON x.key = p.key AND x.other = p.other),
possible AS (SELECT * FROM compared WHERE CASE WHEN felt THEN gap <= 0.8 AND 0.4 * jw + 0.3 * (1 - gap) + 0.2 * t + 0.1 > 0.64 ELSE 0.4 * je + 0.3 * t + 0.2 * jw + 0.1 > 0.64 END),
fused AS (SELECT *, CASE WHEN felt THEN CASE WHEN gap > 0.8 THEN 0 ELSE 0.4 * jw + 0.3 * (1 - gap) + 0.2 * t + 0.1 * {_J.format('ga', 'gb')} END ELSE 0.4 * je + 0.3 * t + 0.2 * jw + 0.1 * {_J.format('ga', 'gb')} END AS f FROM possible),
final AS (SELECT key, other, since, other_since, round(greatest(0, least(1, CASE WHEN named AND je = 0 THEN f * 0.5 ELSE f END)), 6) AS score FROM fused),
both_ways AS (SELECT key, other, since, other_since, score FROM final UNION ALL SELECT other, key, other_since, since, score FROM final),
newer AS (SELECT key, other, max(score) AS score FROM both_ways WHERE score >= 0.65 AND (since, key) < (other_since, other) GROUP BY key, other)"""


@query(f"WITH {_MARKS} SELECT key, min(other) AS kept, score FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY score DESC) AS r FROM newer) WHERE r = 1 GROUP BY key, score")
def dedup_marks(spark, sf):
    return M.dedup_marks(eligible(spark, sf))


@query(f"WITH {_SCORES} SELECT (SELECT count(*) FROM eligible) AS checked, count(*) AS compared, count_if(score >= 0.65) AS matched FROM final")
def dedup_stats(spark, sf):
    rows = eligible(spark, sf)
    return M.dedup_matched(rows).select(F.lit(rows.count()).alias("checked"), "compared", "matched")


@query(f"WITH {ENTRIES} SELECT key FROM entries WHERE coalesce(fragment_type, '') <> 'consumed' AND coalesce(epoch_us(created) <= {AS_OF} - 72 * 3600000000, true)")
def consolidation_eligible(spark, sf):
    return M.group_eligible(memory(spark, sf, "fragment_type", "created")).select("key")


@query()
def consolidate_groups(spark, sf):
    return M.leader_groups(M.group_eligible(memory(spark, sf)))


@query()
def merged_entries(spark, sf):
    rows = M.group_eligible(memory(spark, sf))
    return M.merge_groups(M.leader_groups(rows), rows).select("key", "content", "tags", "level", "fragment_type", F.size("sources").alias("sources"))


_FORGET = f"""{ATTENTION}, own AS (SELECT source FROM entries WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1),
decided AS (SELECT key, CASE WHEN fragment_type = 'consolidated' THEN 'consolidated' WHEN source = (SELECT source FROM own) AND coalesce(feedback_score, 0) >= 0 THEN 'protected source'
  WHEN coalesce(feedback_score, 0) > 0 THEN 'liked' WHEN epoch_us(created) > {AS_OF} - 30 * 86400000000 THEN 'recent' WHEN coalesce(intensity, 0.0) >= 0.3 THEN 'intense'
  WHEN 1 + 0.5 * least(coalesce((SELECT sum(score) FROM listed WHERE contains(lower(content), topic)), 0) / (SELECT sum(score) FROM listed), 1.0) > 1.1 THEN 'attended' ELSE 'forget' END AS decision FROM entries)"""


def _decisions(spark, sf) -> DataFrame:
    rows = memory(spark, sf)
    # The agent's own source, which is protected, is the one that most entries have.
    own = rows.where("source IS NOT NULL").groupBy("source").count().orderBy(F.desc("count"), "source").limit(1).collect()
    return rows.select("key", M.forget_decision([r.source for r in own], listed(spark, sf)).alias("decision"))


@query(f"WITH {_FORGET} SELECT key, decision FROM decided")
def forget_decisions(spark, sf):
    return _decisions(spark, sf)


@query(f"WITH {_FORGET} SELECT count(*) AS scanned, count_if(decision = 'forget') AS candidates, count_if(decision <> 'forget') AS kept FROM decided")
def forget_stats(spark, sf):
    return _decisions(spark, sf).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("decision") == "forget").alias("candidates"), F.count_if(F.col("decision") != "forget").alias("kept"))


@query(f"WITH {ENTRIES}, seen AS (SELECT key, max(ts) AS ts FROM feedback_log WHERE key IS NOT NULL GROUP BY key) SELECT key FROM entries LEFT JOIN seen USING (key) WHERE epoch_us(coalesce(ts, created)) <= {AS_OF} - 60 * 86400000000")
def forget_stale(spark, sf):
    seen = table(spark, sf, "feedback_log").where("key IS NOT NULL").groupBy("key").agg(F.max("ts").alias("ts"))
    return M.stale(memory(spark, sf, "created").join(seen, "key", "left"), "ts", "created").select("key")


_TURNS = "turns AS (SELECT id, '[' || m.role || '] ' || m.content AS line FROM (SELECT id, max(struct_pack(role, content)) AS m FROM messages WHERE id IS NOT NULL AND role IN ('user', 'assistant') AND content IS NOT NULL AND length(trim(content)) >= 20 GROUP BY id))"


@query(f"WITH {_TURNS} SELECT id, line FROM turns")
def distill_messages(spark, sf):
    return M.turns(table(spark, sf, "messages"))


# Lines are cut to pieces of 4000; from piece to piece a text goes on where the whole of a line still fits.
_BATCHES = f"""WITH RECURSIVE {_TURNS},
cut_ AS (SELECT id, line, unnest(range(0, ((length(line) - 1) // 4000 + 1)::BIGINT)) AS part FROM turns),
pieces AS (SELECT floor(id / 300)::BIGINT AS batch, part = 0 AS begins, substr(line, part * 4000 + 1, 4000) AS piece, row_number() OVER (PARTITION BY floor(id / 300) ORDER BY id, part) AS n FROM cut_),
walk AS (SELECT batch, n, 1 AS text_no, length(piece) AS filled, begins, piece FROM pieces WHERE n = 1 UNION ALL
  SELECT p.batch, p.n, CASE WHEN p.begins AND filled + 1 + length(p.piece) <= 4000 THEN text_no ELSE text_no + 1 END,
    CASE WHEN p.begins AND filled + 1 + length(p.piece) <= 4000 THEN filled + 1 + length(p.piece) ELSE length(p.piece) END, p.begins, p.piece
  FROM walk w JOIN pieces p ON p.batch = w.batch AND p.n = w.n + 1)
SELECT batch, count_if(begins) AS messages, string_agg(piece, chr(10) ORDER BY n) AS text FROM walk GROUP BY batch, text_no"""


@query(_BATCHES)
def distill_batches(spark, sf):
    return M.conversations(M.turns(table(spark, sf, "messages")))


@query(f"WITH {ENTRIES}, have AS (SELECT DISTINCT key FROM vectors WHERE model = 'mini-embed-64' AND len(embedding) > 0) SELECT key FROM entries WHERE content IS NOT NULL AND trim(content) <> '' AND key NOT IN (SELECT key FROM have WHERE key IS NOT NULL)")
def missing_vectors(spark, sf):
    return M.missing_vectors(memory(spark, sf, "content"), table(spark, sf, "vectors"), "mini-embed-64")


# Streams, run over what is there now.
@query(f"WITH {TOPIC_LOG} SELECT topic, sum(weight::DECIMAL(18, 6))::DOUBLE AS score, epoch_us(max(ts)) AS last_seen FROM log GROUP BY topic")
def stream_topic_scores(spark, sf):
    target = J.place(spark, "topics")
    J.write_topic_scores(spark, f"{sf}/topic_log.parquet", f"{target}/rows", f"{target}/checkpoint")
    return J.latest(spark, f"{target}/rows").select("topic", "score", F.unix_micros("last_seen").alias("last_seen"))


@query(f"WITH {_TURNS} SELECT id, line FROM turns")
def stream_turns(spark, sf):
    target = J.place(spark, "turns")
    J.write_turns(spark, f"{sf}/messages.parquet", f"{target}/rows", f"{target}/checkpoint")
    return J.turns(spark, f"{target}/rows")


@query(f"""WITH {ENTRIES} SELECT key, superseded_by FROM (SELECT key, lead(key) OVER (PARTITION BY content_hash ORDER BY coalesce(epoch_us(created), 0), key) AS superseded_by FROM entries WHERE content_hash IS NOT NULL) WHERE superseded_by IS NOT NULL""")
def stream_versions(spark, sf):
    target = J.place(spark, "versions")
    # All files in one batch: only then is the order of arrival that of time.
    J.run(J.superseded(J.stream(spark, f"{sf}/memory.parquet", 1_000_000)), f"{target}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{target}/rows/batch={n}"))
    return spark.read.parquet(f"{target}/rows").select("key", "superseded_by")
