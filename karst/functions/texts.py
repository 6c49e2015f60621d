"""Chunks, token overlap and vectors of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 100) -> DataFrame:
    """Chunks of about so many words with overlap; row-local, so there is no shuffle."""
    step = size - overlap
    words = docs.select(key, F.split(F.trim(F.col(text)), r"\s+").alias("w")).where(F.size("w") > 0)
    starts = F.expr(f"sequence(0, greatest(size(w) - {overlap} - 1, 0), {step})")
    out = words.select(key, "w", F.posexplode(starts).alias("chunk", "start"))
    return out.select(key, "chunk", F.size(F.slice("w", F.col("start") + 1, size)).alias("words"), F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, least: float, limit: int = 10_000) -> DataFrame:
    """The k most alike (cosine) of the same collection for each query, at or above a score.

    queries may hold at most `limit` rows, which is checked, so they can go to every task."""
    if queries.limit(limit + 1).count() > limit:
        raise ValueError("too many queries for one pass: pass them in blocks")
    norm = lambda c: F.sqrt(dot(c, c))
    v = vectors.select("vec_id", "label", F.col("embedding").alias("v"), norm(F.col("embedding")).alias("nv"))
    q = queries.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"), norm(F.col("embedding")).alias("nq"))
    pairs = v.join(F.broadcast(q), "label").where("vec_id <> query_id")
    pairs = pairs.select("query_id", "vec_id", (dot(F.col("v"), F.col("q")) / (F.col("nv") * F.col("nq"))).alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def dim_guard(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Each vector with the reason why it is rejected, if it is."""
    reason = F.when(F.col(column).isNull(), "missing").when(F.size(column) != dim, "wrong_length")
    return vectors.withColumn("rejected", reason)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def token_overlap(questions: DataFrame, canon: DataFrame, gap: float = 0.05, others: bool = False) -> DataFrame:
    """The canonical text of most shared words for each question; near ties are ambiguous, none is unresolved.

    Joined on words, so only texts that share one meet; with others, a question's own id is no answer to it."""
    q = questions.select("question_id", tokens(F.col("question")).alias("qt"))
    c = canon.select("canon_id", tokens(F.col("canon")).alias("ct"))
    shared = q.select("question_id", F.size("qt").alias("nq"), F.explode("qt").alias("t")).join(c.select("canon_id", F.size("ct").alias("nc"), F.explode("ct").alias("t")), "t")
    shared = shared.where("question_id <> canon_id") if others else shared
    score = shared.groupBy("question_id", "canon_id", "nq", "nc").agg(F.count("*").alias("both"))
    score = score.withColumn("score", F.col("both") / (F.col("nq") + F.col("nc") - F.col("both")))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "canon_id")
    best = score.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_n = 1")
    out = questions.select("question_id").join(best, "question_id", "left")
    state = F.when(F.col("canon_id").isNull(), "unresolved").when(F.col("score") - F.coalesce("_next", F.lit(0.0)) < gap, "ambiguous").otherwise("resolved")
    return out.select("question_id", "canon_id", F.round("score", 6).alias("score"), state.alias("state"))


def catalog_search(catalog: DataFrame, text: str, words: list[str], keep_unmatched: bool = False) -> DataFrame:
    """Rows by how many of the words they share; others stay at 0 on request."""
    hits = F.size(F.array_intersect(tokens(F.col(text)), F.array(*(F.lit(w.lower()) for w in words))))
    out = catalog.withColumn("hits", hits)
    return out if keep_unmatched else out.where("hits > 0")


def context_block(turns: DataFrame, key: str, order: str, text: str, role: str, last: int = 3) -> DataFrame:
    """The last turns of each conversation as one block in order; rows are cut before they are gathered."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    few = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    lines = F.sort_array(F.collect_list(F.struct(F.col(order), F.concat_ws(": ", role, text).alias("line"))))
    return few.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))
