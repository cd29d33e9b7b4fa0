"""A store over a folder of parquet tables: what an agent calls. Every method reads or appends DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import weights as W
from engram.operators import entries as E
from engram.operators import maintain as M
from engram.operators import search as S
from engram.operators import topics as T
from engram.operators import vocabulary as V
from engram.params import DEFAULT, Params
from engram.session import cut
from engram.sources.config import gated
from engram.sources.schema import TABLES, dimension, evolved

Embed = Callable[[list[str]], list[list[float]]]


class Embedder(Protocol):
    model: str

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


_EMBEDDERS: dict[str, Callable[..., Embedder]] = {}


def register_embedder(name: str, make: Callable[..., Embedder]) -> None:
    _EMBEDDERS[name] = make


def embedder(name: str, **options) -> Embedder:
    return _EMBEDDERS[name](**options)


class MemoryStore:
    """Appends are plain parquet appends; changes go to an update log, which is laid over the entries when they are read."""

    def __init__(self, spark: SparkSession, folder: str, agent: str, primary: bool = False, embed: Embedder | None = None, params: Params = DEFAULT) -> None:
        if not agent:
            raise ValueError("an agent id is required")
        self.spark, self.folder, self.agent, self.primary, self.embed, self.params = spark, folder.rstrip("/"), agent, primary, embed, params

    # Tables.
    def table(self, name: str) -> DataFrame:
        empty = self.spark.createDataFrame([], TABLES[name])
        try:
            return evolved(empty, self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}"))
        except Exception as e:  # a table that nothing was written to yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return empty
            raise

    def append(self, name: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], TABLES[name]).columns
        rows.select(*[c for c in columns if c in rows.columns]).write.mode("append").parquet(f"{self.folder}/{name}")

    def entries(self) -> DataFrame:
        """Entries with updates and feedback, each version but the last superseded."""
        rows = E.with_updates(E.entries(self.table("entries")), self.table("updates"), "invalid_at", "corrected_at", "fragment_type", "consumed_by", "consumed_at", "valid_until")
        score = E.feedback_totals(self.table("feedback")).withColumnRenamed("score", "given")
        last = E.versions(rows).select("key", "superseded_at")
        joined = rows.join(score, "key", "left").join(last, "key", "left")
        return joined.withColumns({"feedback_score": F.coalesce("feedback_score", F.lit(0)) + F.coalesce("given", F.lit(0)), "valid_until": F.coalesce("valid_until", "superseded_at")}).drop("given", "superseded_at")

    def visible(self) -> DataFrame:
        return E.live(self.entries()).where(E.visible_to(F.col("tags"), self.agent, self.primary))

    # Writing.
    def store(self, rows: DataFrame) -> None:
        """Stores (content, tags, category, source, created): hash, key, intensity, sentiment, entities; topics and attention beside it.

        A content stored again at a later time gets a key of its own, with the seconds since the epoch behind the hash."""
        content = F.col("content")
        have = [c for c in ("category", "source", "fragment_type") if c in rows.columns]
        tags = F.col("tags") if "tags" in rows.columns else F.array().cast("array<string>")
        hashed = rows.where(F.length(X.strip(content)) > 0).withColumns({"content_hash": X.content_hash(content), "stored_tags": E.stored_tags(tags, self.agent)})
        known = self.table("entries").select("content_hash").distinct().withColumn("again", F.lit(True))
        base = F.concat(F.lit("memory:frag:"), F.col("content_hash"))
        new = hashed.join(known, "content_hash", "left").withColumn("key", F.when(F.col("again"), F.concat(base, F.lit(":"), F.unix_seconds("created").cast("string"))).otherwise(base))
        strength = X.intensity(content)
        full = new.select("key", "content_hash", "content", F.col("stored_tags").alias("tags"), *have, "created", strength.alias("intensity"), X.sentiment(content).alias("polarity"), X.intensity_label(content, strength).alias("sentiment_label"), F.lit(0).cast("bigint").alias("feedback_score"), X.entities(content).alias("entities"), F.lit(1).alias("level"))
        full = full.withColumn("fragment_type", F.coalesce("fragment_type", F.lit("entry")) if "fragment_type" in have else F.lit("entry")).persist()
        try:
            words = V.keywords(full).join(full.select("key", "created", "sentiment_label", "intensity"), "key")
            weight = F.when(F.col("sentiment_label").like("%positive"), 1.5).when(F.col("sentiment_label").like("%negative"), 1.3).otherwise(1.0)
            self.append("topics", words.select(F.col("word").alias("topic"), F.col("created").alias("ts"), weight.alias("weight"), F.col("key").alias("write_id")))
            self.append("attention", words.where(F.length("word") >= 2).select(F.col("word").alias("topic"), F.col("created").alias("ts"), (self.params.attention_base + F.col("intensity") * self.params.attention_emotion).alias("weight"), F.col("key").alias("write_id")))
            self.append("entries", full)
        finally:
            full.unpersist()

    def feedback(self, key: str, positive: bool) -> None:
        now = F.lit(self.params.as_of).cast("timestamp")
        self.append("feedback", self.spark.range(1).select(F.lit(key).alias("key"), now.alias("ts"), F.lit(1 if positive else -2).cast("bigint").alias("delta"), F.lit(str(uuid.uuid4())).alias("write_id")))

    def update(self, keys: DataFrame, column: str, value: str | None = None) -> None:
        """Sets a column of entries; times are ``as_of``. invalid_at expires them, corrected_at marks them as corrected."""
        now = F.lit(self.params.as_of).cast("timestamp")
        self.append("updates", keys.select("key", now.alias("ts"), F.lit(column).alias("column"), F.lit(value or self.params.as_of).alias("value")))

    def correct(self, keys: list[str]) -> None:
        """Marks entries as corrected: searches leave them out."""
        self.update(self.spark.createDataFrame([(k,) for k in keys], "key string"), "corrected_at")

    # Reading.
    def topics(self, period: str = "all", limit: int = 10) -> DataFrame:
        """The highest topics of a period, at most 30."""
        return T.top(T.scores(T.current(T.writes(self.table("topics")), period, self.params)), min(limit, 30))

    def attention(self, period: str = "all", limit: int = 10) -> DataFrame:
        return T.top(T.scores(T.current(T.writes(self.table("attention")), period, self.params)), limit)

    def is_hot(self, word: str) -> bool:
        found = T.scores(T.current(T.writes(self.table("topics")), "all", self.params)).where(F.col("topic") == word.lower()).first()
        return bool(found and found.score > 1.0)

    def timeline(self, entity: str, limit: int = 20) -> DataFrame:
        return E.timeline(self.entries()).where(F.col("entity") == entity.lower()).orderBy(F.desc_nulls_last("created"), "key").limit(limit)

    def search(self, query: str, top: int | None = None, tags: list[str] | None = None) -> DataFrame:
        """The best entries for a query: text and, with an embedder, vectors, each reranked, then fused."""
        p, rows = self.params, self.visible()
        if tags:
            rows = rows.where(E.tagged(F.col("tags"), tags))
        asked = S.query_terms(self.spark.createDataFrame([(query,)], "query string"))
        words = S.expand_terms(asked, V.synonym_edges(self.table("synonyms")))
        # A merged entry stands for its originals, however long it is.
        said = rows.where((F.length("content") <= p.noise_chars) | (F.col("fragment_type") == "consolidated"))
        found = S.text_search(said, words, p).drop("place").join(rows, "key")
        hot, listed = self.topics("all", p.hot_topics).collect(), self.attention("all", p.hot_topics).collect()
        by_text = S.rerank(found, S.relative(F.col("score")), hot, listed, p).where(F.col("place") <= (top or p.final_limit))
        if self.embed is None:
            return by_text.drop("score")
        vectors = S.usable(self.table("vectors").where(F.col("model") == self.embed.model), "key", "embedding", dimension(self.embed.model))
        base = rows.select(F.col("key").alias("id")).join(vectors, "id")
        own = self.spark.createDataFrame([(r.qid, [float(x) for x in self.embed([query])[0]]) for r in asked.select("qid").distinct().collect()], "qid string, v array<double>")
        near = S.nearest(base, own, p.knn_limit).select("qid", F.col("id").alias("key"), "distance").join(rows, "key").withColumn("query", F.lit(query))
        by_vector = S.rerank(near, W.similarity_of_distance(F.col("distance")), hot, listed, p).where(F.col("place") <= (top or p.final_limit))
        lists = by_text.select("qid", F.col("content").alias("item"), F.lit(1).alias("list"), "place", "key").unionByName(by_vector.select("qid", F.col("content").alias("item"), F.lit(2).alias("list"), "place", "key"))
        fused = S.fuse(lists, p.rrf_k, top or p.final_limit).select("qid", "key", F.col("fused").alias("combined"), "place")
        return fused.join(rows, "key")

    def prefetch(self, query: str, patterns: DataFrame | None = None, locked: bool = False) -> str:
        """The block of text that goes before a turn; empty where nothing is to be looked up."""
        asked = self.spark.createDataFrame([(query,)], "query string")
        none = self.spark.createDataFrame([], "pattern string")
        if locked or gated(asked, patterns if patterns is not None else none, self.params.skip_least).isEmpty():
            return ""
        block = S.render(self.search(query)).first()
        return block.block if block else ""

    # Maintenance.
    def dedup(self) -> DataFrame:
        """Marks near-duplicates of entries that weren't checked yet, among all that are valid; what was looked at counts as checked."""
        rows = M.dedup_eligible(E.live(self.entries()))
        fresh = cut(M.dedup_eligible(rows, self.table("checked")).select("key"))
        marks = cut(M.dedup_marks(rows, self.params, fresh))
        self.update(marks, "invalid_at")
        self.append("checked", fresh)
        return marks

    def consolidate(self, merge: Callable[[list[str]], str] = M.first_sentences) -> DataFrame:
        rows = M.group_eligible(E.live(self.entries()), self.params)
        # Written once and read from there: a model may answer differently the next time.
        merged = cut(M.merge_groups(M.leader_groups(rows, self.params), rows, merge, self.agent))
        self.append("updates", M.consumed(merged, self.params))
        self.append("entries", merged.withColumns({"content_hash": X.content_hash(F.col("content")), "created": F.lit(self.params.as_of).cast("timestamp")}))
        return merged

    def forget(self, protected: list[str] | None = None, dry_run: bool = True) -> DataFrame:
        """(key, decision) of all entries; those to be forgotten expire unless it is a dry run."""
        rows = self.entries()
        decided = rows.select("key", M.forget_decision(protected or [], self.attention("all", self.params.hot_topics).collect(), self.params).alias("decision"))
        if not dry_run:
            self.update(decided.where("decision = 'forget'"), "invalid_at")
        return decided

    def maintenance(self, dry_run: bool = True) -> None:
        self.consolidate()
        self.forget(dry_run=dry_run)

    def discover_synonyms(self) -> DataFrame:
        """Mines synonyms and adds those of terms that have none yet."""
        old = V.synonym_edges(self.table("synonyms"))
        every = V.merged_synonyms(V.synonyms(E.live(self.entries()), self.params), old)
        fresh = every.join(old.select("term").distinct(), "term", "left_anti")
        self.append("synonyms", V.synonym_rows(fresh))
        return fresh

    def dictionary(self, path: str) -> None:
        V.dictionary_lines(V.dictionary(E.live(self.entries()), V.synonym_edges(self.table("synonyms")))).write.mode("overwrite").text(path)

    def distill(self, messages: DataFrame, extract: Callable[[list[str]], list[str]], after: int | None = None) -> None:
        """Stores what a model finds worth keeping in conversations; ``extract`` answers texts with a JSON list each."""
        import pandas as pd

        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"answer": extract(pdf.text.tolist()) if len(pdf) else []})

        found = M.conversations(M.turns(messages, after, self.params), self.params).mapInPandas(run, "answer string")
        item = found.select(F.explode(M.distilled_items(F.col("answer"))).alias("i"))
        named = F.filter(F.array_append(F.split(F.coalesce("i.tags", F.lit("")), ","), F.coalesce("i.category", F.lit("fact"))), lambda t: t != "")
        self.store(item.select(F.col("i.content").alias("content"), F.array_append(named, F.lit("auto-distill")).alias("tags"), F.col("i.category").alias("category"), F.lit("distill").alias("source"), F.lit(self.params.as_of).cast("timestamp").alias("created")))

    def backfill(self) -> int:
        """Embeds entries that have no vector of the embedder's model yet."""
        if self.embed is None:
            return 0
        rows = self.entries()
        keys = M.missing_vectors(rows, self.table("vectors"), self.embed.model)
        n = keys.count()
        if n:
            self.append("vectors", M.backfill(rows, keys, self.embed, self.embed.model))
        return n
