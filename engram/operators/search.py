"""Retrieval: postings, BM25, nearest vectors, expansion, fusion, reranking, rendering, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text as X
from engram.functions import weights as W
from engram.operators import topics as T
from engram.params import DEFAULT, Params


def best(rows: DataFrame, group: list[str], order: list[Column], most: int, place: str = "place") -> DataFrame:
    """The first ``most`` rows of each group, numbered. Spark cuts each partition to ``most`` before the shuffle."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) <= most)


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """(qid, query, term): distinct tokens of each query; qid is the query's hash."""
    return queries.where(F.col(query).isNotNull()).select(X.content_hash(F.col(query)).alias("qid"), F.col(query).alias("query")).distinct().withColumn("term", F.explode(F.array_distinct(X.tokens(F.col("query")))))


def expand_terms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The terms and their synonyms (term, synonym), each once."""
    more = terms.join(synonyms, "term").select("qid", "query", F.col("synonym").alias("term"))
    return terms.select("qid", "query", "term").unionByName(more).distinct()


def together_expansion(terms: DataFrame, pairs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, query, entity, n): entities that most often stand together with an entity of the query, at most three."""
    both = pairs.select(F.col("entity_a").alias("term"), F.col("entity_b").alias("other"), "n").unionByName(pairs.select(F.col("entity_b").alias("term"), F.col("entity_a").alias("other"), "n")).where(F.col("n") >= p.expansion_least)
    found = terms.join(both, "term").groupBy("qid", "query", "other").agg(F.max("n").alias("n"))
    fresh = found.join(terms.select("qid", F.col("term").alias("other")), ["qid", "other"], "left_anti")
    return best(fresh, ["qid"], [F.desc("n"), F.asc("other")], p.expansion_limit).select("qid", "query", F.col("other").alias("entity"), "n")


def bm25(rows: DataFrame, terms: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, key, score): BM25 of the entries that hold a term of the query.

    Documents' tokens are counted before they meet the terms, only those of some query go on, and the two totals are one row
    on the driver. Terms that stand in most entries are counted in part before each shuffle.
    """
    docs = rows.where("content IS NOT NULL").select("key", X.tokens(F.col("content")).alias("tokens"))
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    average = total / n if n and total else 1.0
    wanted = terms.select("term").distinct()
    tf = docs.select("key", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("key", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (p.bm25_k1 + 1) / (F.col("tf") + p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * F.col("dl") / average))
    scored = tf.join(df, "term").select("key", "term", part.alias("part"))
    return scored.join(terms.select("qid", "term").distinct(), "term").groupBy("qid", "key").agg(F.round(F.sum("part"), 6).alias("score"))


def text_search(rows: DataFrame, terms: DataFrame, p: Params = DEFAULT, most: int | None = None) -> DataFrame:
    """(qid, key, score, place): the best entries of each query, of those already filtered."""
    return best(bm25(rows, terms, p), ["qid"], [F.desc("score"), F.asc("key")], most or p.text_limit)


def nearest(base: DataFrame, queries: DataFrame, k: int, id_type: str = "string", chunk: int = 8192, block: int = 1024) -> DataFrame:
    """(qid, id, distance, place): for each query (qid, v) the k rows (id, v) of the smallest cosine distance; exact.

    Both sides are packed into rows of up to ``chunk`` and ``block`` vectors, by hash; each pair of a chunk and a block is one
    matrix product, which returns k rows a query. Nothing is broadcast, and no task holds more than one pair. Vectors
    with nulls, NaN or of length zero must have been left out; a query doesn't find its own id; ties go to the smaller id.
    """
    def packed(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        parts = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64(name), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("id"), "v"))).alias("rows")), parts

    left, _ = packed(base, "id", chunk)
    right, blocks = packed(queries, "qid", block)
    pairs = left.select("rows", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("part")).join(right.select("part", F.col("rows").alias("asks")), "part").repartition("part", F.xxhash64(F.col("rows")[0]["id"]))

    def matrix(rows) -> np.ndarray:
        x = np.array([np.asarray(r["v"], np.float64) for r in rows])
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, asks in zip(pdf["rows"], pdf["asks"]):
                ids, qids = np.array([r["id"] for r in rows]), np.array([r["id"] for r in asks])
                d = np.round(1 - matrix(asks) @ matrix(rows).T, 12)
                d[qids[:, None] == ids[None]] = np.inf
                top = np.argsort(d, axis=1, kind="stable")[:, :k]  # ids are in order: ties go to the smaller
                i = np.repeat(np.arange(len(qids)), top.shape[1])
                j = top.reshape(-1)
                ok = np.isfinite(d[i, j])
                yield pd.DataFrame({"qid": qids[i][ok], "id": ids[j][ok], "distance": d[i, j][ok]})

    found = pairs.select("rows", "asks").mapInPandas(run, f"qid {id_type}, id {id_type}, distance double")
    return best(found.withColumn("distance", F.round("distance", 6)), ["qid"], [F.asc("distance"), F.asc("id")], k)


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v): one usable vector a key."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == dim)).where(ok).groupBy(F.col(key).alias("id")).agg(F.max(v).alias("v"))


def fuse(lists: DataFrame, k: int, most: int) -> DataFrame:
    """Reciprocal rank fusion of (qid, item, list, place, key): (qid, item, key, fused, place). Ties: the earlier list, then the better place in it."""
    one = lists.groupBy("qid", "item").agg(F.round(F.sum(1 / (k + F.col("place"))), 9).alias("fused"), F.min(F.struct("list", "place", "key")).alias("first"))
    return best(one, ["qid"], [F.desc("fused"), F.asc("first"), F.asc("item")], most).select("qid", "item", "first.key", "fused", "place")


def rerank(found: DataFrame, similarity: Column, hot: list, listed: list, p: Params = DEFAULT) -> DataFrame:
    """Candidates with their six factors, their product ``combined`` and their place within the query."""
    matched, total = T.matched_attention(F.col("content"), listed)
    six = {
        "similarity": similarity,
        "time": W.decay(F.col("created"), p),
        "emotion": W.emotion_weight(F.col("intensity"), p),
        "feedback": W.feedback_weight(F.col("feedback_score"), p),
        "hot": W.hot_weight(T.hot_hits(F.col("content"), hot, p), p),
        "attention": W.attention_weight(matched, F.lit(total), p),
    }
    rows = found.withColumns({f"w_{n}": F.round(c, 6) for n, c in six.items()})
    product = F.lit(1.0)
    for n in six:
        product = product * F.col(f"w_{n}")
    return rows.withColumn("combined", F.round(product, 6)).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("combined"), F.asc("key"))))


def relative(score: Column) -> Column:
    """A text score over the highest of its query; 1 where that is below 0.001."""
    high = F.max(score).over(Window.partitionBy("qid"))
    return F.when(high < 0.001, 1.0).otherwise(score / high)


def render(results: DataFrame, tag: str = "memory") -> DataFrame:
    """(qid, block): the results of each query as one text; a query has at most ``final_limit`` of them."""
    icon = F.when(F.col("sentiment_label").like("%positive"), "+").when(F.col("sentiment_label").like("%negative"), "-").otherwise("=")
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("content", F.lit("")), F.lit("\n  "), icon, F.lit(" "), F.concat_ws(",", "tags"), F.lit(" "), F.format_string("%.2f", "combined"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    return results.groupBy("qid").agg(F.concat(F.lit(f"<{tag}>\n"), body, F.lit(f"\n</{tag}>")).alias("block"))


def evaluate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, hit): whether any expected word stands, without regard to case, in any result."""
    words = expected.select("qid", F.explode("expected").alias("word")).where("word IS NOT NULL")
    hits = results.join(words, "qid").groupBy("qid").agg(F.max(F.contains(F.lower("content"), F.lower("word")).cast("int")).alias("hit"))
    return expected.select("qid").distinct().join(hits, "qid", "left").select("qid", F.coalesce("hit", F.lit(0)).alias("hit"))
