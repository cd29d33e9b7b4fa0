"""Maintenance: near-duplicate marks, consolidation, forgetting, distillation, missing vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text as X
from engram.functions import weights as W
from engram.operators import topics as T
from engram.operators import vocabulary as V
from engram.operators.ranked import SHARD, alike, bigrams, ranked_words, rarest, shared_grams, shared_words
from engram.operators.search import best
from engram.params import DEFAULT, Params
from engram.session import cut


def dedup_eligible(rows: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Entries to be checked: not checked before, still valid, not disliked, with at least four characters."""
    ok = rows.where("invalid_at IS NULL AND coalesce(feedback_score, 0) <> -1 AND length(content) >= 4")
    return ok.join(checked.select("key").distinct(), "key", "left_anti") if checked is not None else ok


def dedup_ranked(words: DataFrame, p: Params = DEFAULT, keep: Callable | None = None) -> DataFrame:
    """(key, other, raw): ``dedup_candidates`` of words (key, words). With len, s and e as well, pairs are as ``shared_words`` has them, all if there are several shards."""
    opened = words.select(F.explode(F.array_append("words", F.lit(""))).alias("word"))  # no word is empty: this one counts the entries
    df = cut(opened.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df > 1 OR word = ''"))
    n = next((r.df for r in df.where("word = ''").collect()), 0)
    hashed = words.withColumn("w", _hashes(F.col("words"))).drop("words")
    ranked = ranked_words(hashed, df.where("word <> '' AND df > 1"), n, p.dedup_terms)
    if n <= SHARD:
        return shared_words(ranked, n, p.dedup_candidates, keep)
    return best(shared_words(ranked, n, p.dedup_candidates), ["key"], [F.desc("raw"), F.asc("other")], p.dedup_candidates).drop("place")


def dedup_candidates(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(key, other, raw): for each entry the entries that share one of its rarest terms, the 20 of the highest score. A ranked list to look at; marks come from ``dedup_pairs``, which has no such limit.

    An entry asks with its ``dedup_terms`` rarest terms, so that common ones, which say least, don't bring all entries
    together. raw is their summed inverse document frequency.
    """
    return dedup_ranked(rows.select("key", F.array_distinct(X.content_terms(F.col("content"))).alias("words")), p)


def fusion_score(words: Column, grams: Column, named: Column, text: Column, strengths: tuple[Column, Column], both_named: Column, p: Params = DEFAULT) -> Column:
    """Similarity of two entries from the Jaccard similarities of their words, bigrams and entities, the text score, and how strongly they are felt. It never falls as one of the similarities rises."""
    gap = F.abs(strengths[0] - strengths[1])
    felt = F.when(gap > p.dedup_gap, 0.0).otherwise(0.40 * words + 0.30 * (1 - gap) + 0.20 * text + 0.10 * grams)
    fact = 0.40 * named + 0.30 * text + 0.20 * words + 0.10 * grams
    score = F.when((F.abs(strengths[0]) > 0.3) | (F.abs(strengths[1]) > 0.3), felt).otherwise(fact)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(both_named & (named == 0), score * 0.5).otherwise(score))), 6)


def _named(c: str = "entities") -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda e: F.lower(X.strip(e))), lambda e: e.isNotNull() & (e != "")))


def _hashes(c: Column) -> Column:
    return F.transform(F.array_distinct(c), lambda x: F.xxhash64(x))


def _of(df: DataFrame, key: str, n: int) -> DataFrame:
    """The frame under the name of a pair's side."""
    return df.select(F.col("key").alias(key), *[F.col(c).alias(f"{c}{n}") for c in df.columns if c != "key"])


def dedup_scores(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(key, other, score) of the candidate pairs. Words and entities are compared where the pairs are found; texts travel to blocks of pairs, where bigrams are compared; the score itself is Spark's."""
    pairs = dedup_ranked(dedup_sides(rows), p)
    counted = shared_grams(pairs, rows.select("key", F.lower("content").alias("low")), rows.count())
    text = F.least(F.col("raw") / 20, F.lit(1.0))
    return counted.select("key", "other", fusion_score(F.col("jw"), F.col("jg"), F.col("je"), text, (F.col("s"), F.col("s2")), F.col("both"), p).alias("score"))


def dedup_sides(rows: DataFrame) -> DataFrame:
    """(key, words, len, s, e): words, how many, strength and hashes of entities of each entry."""
    words = F.array_distinct(X.content_terms(F.col("content")))
    return rows.select("key", words.alias("words"), _hashes(_named()).alias("e"), F.coalesce("intensity", F.lit(0.0)).alias("s")).withColumn("len", F.size("words"))


def may_match(p: Params) -> Callable:
    """Whether pairs (jw, je, t, s, s2, both), as arrays, can reach the threshold of ``fusion_score`` with all bigrams the same."""
    def run(jw: np.ndarray, je: np.ndarray, t: np.ndarray, s: np.ndarray, s2: np.ndarray, both: np.ndarray) -> np.ndarray:
        gap = np.abs(s - s2)
        felt = np.where(gap > p.dedup_gap, 0.0, 0.40 * jw + 0.30 * (1 - gap) + 0.20 * t + 0.10)
        score = np.where((np.abs(s) > 0.3) | (np.abs(s2) > 0.3), felt, 0.40 * je + 0.30 * t + 0.20 * jw + 0.10)
        return np.clip(np.where(both & (je == 0), score / 2, score), 0, 1) >= p.dedup_threshold - 1e-5

    return run


def dedup_matched(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(compared, matched): how many pairs ``dedup_scores`` has, and how many of them reach the threshold.

    A score never falls as a similarity rises, so texts are compared only for pairs that words, entities and strengths leave
    a chance; those are told where the pairs are found."""
    found = cut(dedup_ranked(dedup_sides(rows), p, may_match(p)))
    pairs = found.where("key IS NOT NULL")
    used = pairs.select("key").unionByName(pairs.select(F.col("other").alias("key"))).distinct()
    # Bigrams carry a number for the key: those entries are few.
    texts = cut(rows.join(used, "key", "left_semi").select("key", F.lower("content").alias("low"), F.monotonically_increasing_id().alias("id")))
    sets = texts.select("key", "id").join(bigrams(texts.select("id", "low")), "id").select("key", "g")
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = pairs.repartition(parts, "key").join(sets, "key").repartition(parts, "other").join(sets.select(F.col("key").alias("other"), F.col("g").alias("g2")), "other")
    score = fusion_score(F.col("jw"), _overlap("g", "g2"), F.col("je"), F.least(F.col("raw") / 20, F.lit(1.0)), (F.col("s"), F.col("s2")), F.col("both"), p)
    matched = full.agg(F.count_if(score >= p.dedup_threshold).alias("matched"))
    # Over one shard, rows without a key count the pairs; over several, all pairs are here.
    counted = F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("raw"))), F.count("key"), F.lit(0)).cast("long")
    return found.agg(counted.alias("compared")).crossJoin(matched)


def _overlap(a: str, b: str) -> Column:
    """Jaccard similarity of two lists of distinct numbers; 0 if either is empty."""
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / (F.size(a) + F.size(b) - same))


def dedup_members(rows: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """(key, at, id, size, first, fresh, content, e, s): entries with their class, which is that of equal text, entities and strength.

    All of a class score alike, so classes are compared and not entries. fresh: the entry is among those asking, or there is no such list."""
    lone = F.to_timestamp(F.lit("1970-01-01 00:00:00"))
    each = rows.select("key", F.coalesce("created", lone).alias("at"), "content", F.array_sort(_hashes(_named())).alias("e"), F.coalesce("intensity", F.lit(0.0)).alias("s"))
    if asking is None:
        each = each.withColumn("fresh", F.lit(True))
    else:
        each = each.join(asking.select("key", F.lit(True).alias("fresh")).distinct(), "key", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    w = Window.partitionBy("content", "e", "s", "fresh")
    named = cut(each.withColumns({"leads": F.min("key").over(w), "size": F.count(F.lit(1)).over(w)}))
    numbers = cut(named.where("key = leads").select("leads", F.monotonically_increasing_id().alias("id")))
    return named.join(numbers, "leads").withColumn("first", F.expr("key = leads")).drop("leads")


def dedup_pairs(classes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(id, o, score): every pair of classes that reaches the threshold in the better of both directions, id not above o; a class with itself where it has more than one entry.

    No pair is left out for its place in a list. Classes meet where they share an entity, or where one has none: others
    stay at half their score, below the threshold. ``alike`` leaves the pairs that signatures can't rule out, whose texts
    are then compared.
    """
    if p.dedup_threshold <= 0.5:
        raise ValueError("dedup_pairs: at a threshold of 0.5 or less, entries that share no word may reach it")
    # Texts are few bytes for the work they make: they are spread by number, which adaptive execution leaves as it is.
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = classes.repartition(parts, "id").select("id", "size", "fresh", "e", "s", "content")
    lists = cut(texts.withColumn("words", F.array_distinct(X.content_terms(F.col("content")))).withColumn("w", _hashes(F.col("words"))))
    n, many = lists.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    df = lists.select("size", F.explode("words").alias("word")).groupBy("word").agg(F.sum("size").alias("df")).where("df > 1")
    rare = rarest(lists, df, n, p.dedup_terms)
    about = lists.select("id", (F.col("size") > 1).alias("more"), "fresh", "s", "w", "e").join(rare, "id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    about = cut(about.select("id", "more", "fresh", "s", "w", "e", none("rare", "long"), none("idf", "double")))
    found = cut(alike(about, many, p.dedup_threshold, p.dedup_gap))
    second = lambda d: d.select(F.col("id").alias("o"), *[F.col(c).alias(f"{c}2") for c in d.columns if c != "id"])
    sets = about.select("id", "e", "s", "w", "rare", "idf")
    pairs = found.repartition(4 * parts, "id").join(sets, "id").repartition(4 * parts, "o").join(second(sets), "o")
    raw = lambda x, y: F.aggregate(F.zip_with(f"rare{x}", f"idf{x}", lambda r, i: F.when(F.array_contains(f"w{y}", r), i).otherwise(0.0)), F.lit(0.0), lambda acc, v: acc + v)
    shared = F.least(F.round(F.greatest(raw("", "2"), raw("2", "")), 6) / 20, F.lit(1.0))
    score = lambda grams: fusion_score(F.col("jw"), grams, F.col("je"), F.col("t"), (F.col("s"), F.col("s2")), F.col("both"), p)
    both = (F.size("e") > 0) & (F.size("e2") > 0)
    pairs = pairs.select("id", "o", "s", "s2", both.alias("both"), _overlap("w", "w2").alias("jw"), _overlap("e", "e2").alias("je"), shared.alias("t"))
    # Bigrams are made only of texts whose words let them decide.
    pairs = cut(pairs.where(score(F.lit(1.0)) >= p.dedup_threshold))
    used = pairs.select("id").unionByName(pairs.select(F.col("o").alias("id"))).distinct()
    text = cut(bigrams(lists.join(used, "id", "left_semi").select("id", F.lower("content").alias("low"))))
    full = pairs.repartition(4 * parts, "id").join(text, "id").repartition(4 * parts, "o").join(second(text), "o")
    return full.select("id", "o", score(_overlap("g", "g2")).alias("score")).where(F.col("score") >= p.dedup_threshold)


def dedup_marks(rows: DataFrame, p: Params = DEFAULT, asking: DataFrame | None = None) -> DataFrame:
    """(key, kept, score): entries to be marked invalid, each with the best newer entry that takes its place. Of equal times the smaller key is the older.

    With ``asking``, only pairs of which at least one is among those are compared, against all rows."""
    members = cut(dedup_members(rows, asking))
    one = dedup_pairs(members.where("first"), p)
    # The better of both directions. Entries meet classes, so that copies don't meet each other.
    edges = cut(one.unionByName(one.select(F.col("o").alias("id"), F.col("id").alias("o"), "score")).groupBy("id", "o").agg(F.max("score").alias("score")))
    entry = members.select("key", "at", "id")
    newest = entry.groupBy(F.col("id").alias("o")).agg(F.max(F.struct("at", "key")).alias("newest"))
    asks = entry.join(edges, "id").join(newest, "o").where(F.struct("at", "key") < F.col("newest"))
    asks = asks.withColumn("r", F.rank().over(Window.partitionBy("key").orderBy(F.desc("score")))).where("r = 1").select("o", "at", "key", "score")
    line = asks.withColumn("member", F.lit(None).cast("string")).unionByName(entry.select(F.col("id").alias("o"), "at", "key", F.lit(None).cast("double").alias("score"), F.col("key").alias("member")))
    # An entry comes before itself as a member: only newer ones count.
    w = Window.partitionBy("o").orderBy(F.desc("at"), F.desc("key"), F.asc_nulls_first("member")).rowsBetween(Window.unboundedPreceding, 0)
    kept = line.withColumn("kept", F.min("member").over(w)).where("member IS NULL")
    return kept.groupBy("key").agg(F.min("kept").alias("kept"), F.max("score").alias("score"))


def group_eligible(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Entries old enough to be merged, and not consumed; one without a time passes."""
    limit = F.lit(p.as_of).cast("timestamp") - F.expr(f"INTERVAL {p.group_age_hours} HOURS")
    return rows.where("coalesce(fragment_type, '') <> 'consumed'").where(F.coalesce(F.col("created") <= limit, F.lit(True)))


def leader_groups(rows: DataFrame, p: Params = DEFAULT, rounds: int = 200) -> DataFrame:
    """(leader, key): groups of entries, each of which shares two or more of its five keywords with its leader.

    The same as taking entries in order of (created, key), letting each that isn't in a group yet lead one of all later
    ones that share two keywords with it. Entries meet in groups by pair of keywords, at most ten an entry, so nothing
    compares all entries. In each round those that come first in all their pairs lead, and those that share a pair with
    a leader leave. Rounds are checkpointed; the driver sees one count a round. Groups of one are left out.
    """
    words = V.keywords(rows).groupBy("key").agg(F.array_sort(F.collect_list("word")).alias("words"))
    order = rows.select("key", F.struct(F.coalesce(F.unix_micros("created"), F.lit(0)).alias("t"), F.col("key").alias("k")).alias("o"))
    opened = words.select("key", "words", F.posexplode("words").alias("i", "a")).select("key", "a", F.explode(F.slice("words", F.col("i") + 2, F.size("words"))).alias("b"))
    member = cut(opened.select("key", F.xxhash64("a", "b").alias("pair"), "a", "b").join(order, "key").select("key", "o", F.struct("a", "b").alias("pair")))
    left, leaders = member, None
    for _ in range(rounds):
        first = left.groupBy("pair").agg(F.min("o").alias("first"))
        state = left.join(first, "pair").groupBy("key").agg(F.min(F.expr("first = o")).alias("leads"))
        new = cut(left.join(state.where("leads").select("key"), "key", "left_semi").select("key", "o", "pair"))
        leaders = new if leaders is None else leaders.unionByName(new)
        touched = left.join(new.select("pair").distinct(), "pair", "left_semi").select("key").distinct()
        left = cut(left.join(touched, "key", "left_anti"))
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"leader_groups: not settled after {rounds} rounds")
    leads = leaders.groupBy("pair").agg(F.min("o").alias("lead"))
    mine = leaders.select("key").distinct().withColumn("is_leader", F.lit(True))
    joined = member.join(leads, "pair").groupBy("key").agg(F.min("lead").alias("lead")).join(mine, "key", "left")
    out = joined.select(F.when(F.col("is_leader"), F.col("key")).otherwise(F.col("lead.k")).alias("leader"), "key")
    sizes = out.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.group_least)
    return out.join(sizes.select("leader"), "leader", "left_semi")


def first_sentences(texts: list[str]) -> str:
    """The default merge: each distinct text, whole, since nothing else of it can be found afterwards."""
    return "\n".join(f"- {t}" for t in dict.fromkeys(t.strip() for t in texts if t and t.strip()))


def merge_groups(groups: DataFrame, rows: DataFrame, merge: Callable[[list[str]], str] = first_sentences, agent: str = "main") -> DataFrame:
    """(key, content, tags, level, fragment_type, sources): one merged entry a group. ``merge`` may call a model; it gets the texts in order of key."""
    body = groups.join(rows.select("key", "content", "tags", "level"), "key")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        tags = sorted({t.strip() for ts in pdf.tags if ts is not None for t in ts if t and t.strip() and not t.startswith("session:")})
        level = int(pdf.level.fillna(1).max()) + 1
        return pd.DataFrame({"content": [merge([t for t in pdf.content if t is not None])], "tags": [tags], "level": [level], "sources": [pdf.key.tolist()]})

    merged = body.groupBy("leader").applyInPandas(run, "content string, tags array<string>, level int, sources array<string>")
    return merged.select(F.concat(F.lit("memory:frag:"), X.content_hash(F.col("content"))).alias("key"), "content", "tags", "level", F.lit("consolidated").alias("fragment_type"), "sources")


def consumed(merged: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(key, ts, column, value): the update log that marks merged entries as consumed."""
    each = merged.select(F.explode("sources").alias("key"), F.col("key").alias("by"))
    change = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in (("fragment_type", F.lit("consumed")), ("consumed_by", F.col("by")), ("consumed_at", F.lit(p.as_of)))]))
    return each.select("key", F.lit(p.as_of).cast("timestamp").alias("ts"), change.alias("c")).select("key", "ts", "c.column", "c.value")


def forget_decision(protected: list[str], listed: list, p: Params = DEFAULT) -> Column:
    """Why an entry is kept, or ``forget``: the first reason that holds."""
    matched, total = T.matched_attention(F.col("content"), listed)
    fb = F.coalesce("feedback_score", F.lit(0))
    limit = F.lit(p.as_of).cast("timestamp") - F.expr(f"INTERVAL {p.forget_age_days} DAYS")
    own = F.col("source").isin(*protected) if protected else F.lit(False)
    return (
        F.when(F.col("fragment_type") == "consolidated", "consolidated")
        .when(own & (fb >= 0), "protected source")
        .when(fb > 0, "liked")
        .when(F.col("created") > limit, "recent")
        .when(F.coalesce("intensity", F.lit(0.0)) >= p.forget_intensity, "intense")
        .when(W.attention_weight(matched, F.lit(total), p) > p.protect_attention, "attended")
        .otherwise("forget")
    )


def stale(rows: DataFrame, last_accessed: str, created: str, p: Params = DEFAULT) -> DataFrame:
    """Full rows that weren't touched for so long; one without any time stays."""
    limit = F.lit(p.as_of).cast("timestamp") - F.expr(f"INTERVAL {p.forget_full_days} DAYS")
    return rows.where(F.coalesce(last_accessed, created) <= limit)


def turns(messages: DataFrame, after: int | None = None, p: Params = DEFAULT) -> DataFrame:
    """(id, line): messages that distillation reads, each once and whole: from user or assistant, long enough."""
    ok = messages.where("id IS NOT NULL AND role IN ('user', 'assistant') AND content IS NOT NULL").where(F.length(F.trim("content")) >= p.distill_least)
    if after is not None:
        ok = ok.where(F.col("id") > after)
    one = ok.groupBy("id").agg(F.max(F.struct("role", "content")).alias("m"))
    return one.select("id", F.concat(F.lit("["), F.col("m.role"), F.lit("] "), F.col("m.content")).alias("line"))


def conversations(lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(batch, messages, text): lines of up to ``distill_rows`` consecutive ids, joined in order; a row for each ``distill_chars`` characters.

    Every line is in some text; a longer one is split over several. messages counts the lines that begin in a text.
    Batches are cut by id, so all rows are read and no global numbering is needed."""
    most = p.distill_chars

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, counts = [], []
        for line in pdf.sort_values("id").line:
            for i in range(0, len(line), most):
                piece = line[i : i + most]
                if i == 0 and texts and len(texts[-1]) + 1 + len(piece) <= most:
                    texts[-1] += "\n" + piece
                    counts[-1] += 1
                else:
                    texts.append(piece)
                    counts.append(int(i == 0))
        return pd.DataFrame({"batch": int(pdf.batch.iloc[0]), "messages": counts, "text": texts})

    numbered = lines.select(F.floor(F.col("id") / p.distill_rows).alias("batch"), "id", "line")
    return numbered.groupBy("batch").applyInPandas(run, "batch long, messages long, text string")


def distilled_items(answer: Column) -> Column:
    """Items of a model's answer: the outermost list in it, its objects with at least ten characters of content."""
    first, last = F.instr(answer, "["), F.length(answer) - F.instr(F.reverse(answer), "]") + 1
    body = F.when((first > 0) & (last > first), F.substring(answer, first, last - first + 1))
    items = F.from_json(body, "array<struct<content:string,category:string,tags:string>>")
    return F.coalesce(F.filter(items, lambda x: x.isNotNull() & (F.length(F.trim(x["content"])) >= 10)), F.array().cast("array<struct<content:string,category:string,tags:string>>"))


def missing_vectors(rows: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Keys of entries with a content and no vector of the model."""
    have = vectors.where((F.col("model") == model) & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("key").distinct()
    return rows.where("content IS NOT NULL AND trim(content) <> ''").select("key").join(have, "key", "left_anti")


def backfill(rows: DataFrame, keys: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str) -> DataFrame:
    """(key, model, embedding) for the keys, by an embedder that is called once a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf.key, "model": model, "embedding": embed(pdf.content.tolist()) if len(pdf) else []})

    return rows.select("key", "content").join(keys, "key", "left_semi").mapInPandas(run, "key string, model string, embedding array<float>")
