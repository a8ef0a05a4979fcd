"""BM25 over tokenised rows, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memloom.operators.skew import BROADCAST_ROWS, skew_join, small_side
from memloom.session import materialize, rows_of

K1, B = 1.5, 0.75


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(case_id, id, score) of the rows that share a term with the query.

    ``docs``: (id, tokens); ``queries``: (case_id, tokens), broadcast while they have at most ``BROADCAST_ROWS`` terms. A query term counts as often as it is asked. idf = ln(1 + (N - n + .5) / (n + .5)) over all rows, N at least 1.
    Rows without tokens, null ids and null token arrays score nothing. Only postings of query terms are shuffled.
    """
    docs = docs.where(F.col("id").isNotNull())
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.array_size("tokens"), F.lit(0))).alias("avg")).first()
    asked = materialize(queries.select("case_id", F.explode("tokens").alias("term")).groupBy("case_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    small = rows_of(asked) <= BROADCAST_ROWS
    terms = asked.select("term").distinct()
    found = docs.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    # The rows shrink to query terms before anything is counted or moved.
    found = found.join(F.broadcast(terms), "term", "left_semi") if small else skew_join(found, terms, ["term"], "left_semi")
    found = materialize(found.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "hits")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(float(max(size["n"], 1)))
    idf = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = asked.join(idf, "term").select("case_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    tf = F.col("tf")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(float(size["avg"] or 1.0))))
    # A term may have many rows on both sides: beyond a broadcast they are salted.
    scored = found.join(F.broadcast(weights), "term") if small else skew_join(found, weights, ["term"], keys=0)
    return scored.groupBy("case_id", "id").agg(F.sum(part).alias("score"))


def normalised(scores: DataFrame, value: str = "score") -> DataFrame:
    """The positive scores of a case as shares of their sum."""
    sums = scores.where(F.col(value) > 0).groupBy("case_id").agg(F.sum(value).alias("_sum"))
    return scores.where(F.col(value) > 0).join(small_side(sums, "sums"), "case_id").withColumn(value, F.col(value) / F.col("_sum")).drop("_sum")
