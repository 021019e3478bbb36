"""Matching names by trigrams, through an inverted index of trigrams where there are many queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RESOLVE_MARGIN, TRIGRAM_MIN
from ..functions.text import trigram_similarity, trigrams


def fuzzy_search(rows: DataFrame, query: str, threshold: float = TRIGRAM_MIN, name: str = "name_en") -> DataFrame:
    """Rows at least that similar, best first, then by name."""
    out = rows.withColumn("similarity", trigram_similarity(F.col(name), F.lit(query)))
    return out.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), name, "id")


def fuzzy_join_indexed(queries: DataFrame, names: DataFrame, threshold: float = TRIGRAM_MIN) -> DataFrame:
    """(query, name, similarity) of all pairs at least that similar; queries has query, names has name.

    Distinct strings are split into trigrams and joined on them; the count of a
    pair is its intersection, and the set sizes give the union. A pair at
    threshold t shares at least t of the query's trigrams, so the commonest
    trigrams of a query needn't be probed: its prefix of the rarest suffices.
    """
    q = queries.select("query").where("query is not null").distinct().withColumn("g", trigrams(F.col("query"))).withColumn("nq", F.size("g"))
    d = names.select("name").where("name is not null").distinct().withColumn("g", trigrams(F.col("name"))).withColumn("nd", F.size("g"))
    posts = d.select("name", "nd", F.explode("g").alias("t"))
    freq = posts.groupBy("t").agg(F.count("*").alias("df"))
    probes = q.select("query", "nq", "g", F.explode("g").alias("t")).join(freq, "t", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("df", "t"))
    prefix = probes.withColumn("r", rank).where(F.col("r") <= F.col("nq") - F.ceil(F.col("nq") * threshold - 1e-9) + 1).where("df > 0")
    pairs = prefix.select("query", "t").join(posts.select("name", "t"), "t").select("query", "name").distinct()
    both = pairs.join(q, "query").join(d.select("name", "nd", F.col("g").alias("h")), "name")
    common = F.size(F.array_intersect("g", "h"))
    return both.withColumn("similarity", common / (F.col("nq") + F.col("nd") - common)).where(F.col("similarity") >= threshold).select("query", "name", "similarity")


def resolve_entity(queries: DataFrame, names: DataFrame, threshold: float = TRIGRAM_MIN, margin: float = RESOLVE_MARGIN, k: int = 5) -> DataFrame:
    """Per query: resolved, ambiguous or no match; the best id and its similarity, whether inexact, and the candidates.

    names has id and name. Ties of one name are ordered by id.
    """
    hits = fuzzy_join_indexed(queries, names, threshold).join(names.select("id", "name"), "name")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "name", "id")
    top = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    best = top.groupBy("query").agg(
        F.max(F.when(F.col("r") == 1, F.col("similarity"))).alias("best"),
        F.max(F.when(F.col("r") == 2, F.col("similarity"))).alias("second"),
        F.max(F.when(F.col("r") == 1, F.col("id"))).alias("best_id"),
        F.array_sort(F.collect_list(F.struct("r", "id"))).alias("c"),
    )
    out = queries.select("query").distinct().join(best, "query", "left")
    close = F.col("second").isNotNull() & (F.col("best") - F.col("second") < margin)
    status = F.when(F.col("best").isNull(), "no match").when(close, "ambiguous").otherwise("resolved")
    return out.select("query", status.alias("status"), F.when(status == "resolved", F.col("best_id")).alias("id"), F.round("best", 3).alias("similarity"), (F.col("best") < 0.999).alias("inexact"), F.transform("c", lambda x: x["id"]).alias("candidates"))


def resolve_scoped(queries: DataFrame, scoped: DataFrame, **options) -> DataFrame:
    """resolve_entity within rows already narrowed to an area or kind (id, name)."""
    return resolve_entity(queries, scoped.select("id", "name"), **options)
