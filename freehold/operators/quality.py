"""Checks of facts and marts that come out as small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import norm_name
from ..sources.work import kept


def key_integrity(facts: DataFrame, key: str, by: str = "source_id") -> DataFrame:
    """Rows and distinct keys by source; equal where the key holds."""
    return facts.groupBy(by).agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("distinct_keys"))


def seam_check(facts: DataFrame, day: str, cutover: str) -> DataFrame:
    """Monthly counts by source, and rows of the gateway on the wrong side of the cutover."""
    d = F.col(day).cast("date")
    early = (F.col("source_id") != 1) & (d <= F.lit(cutover).cast("date"))
    return facts.groupBy(F.trunc(d, "month").alias("month")).agg(F.count_if(F.col("source_id") == 1).alias("bulk_rows"), F.count_if(F.col("source_id") != 1).alias("gateway_rows"), F.count_if(early).alias("gateway_before_cutover"))


def mart_reconciliation(raw: DataFrame, mart: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Raw sales against the mart's total, which is split into canonical areas and ambiguous old ones."""
    m = mart.join(ambiguous.select(F.col("old_area_id").alias("area_id"), F.lit(True).alias("_amb")), "area_id", "left")
    sums = m.agg(F.sum(F.when(F.col("_amb").isNull(), F.col("sale_cnt"))).alias("canonical_total"), F.coalesce(F.sum(F.when(F.col("_amb"), F.col("sale_cnt"))), F.lit(0)).alias("ambiguous_total"))
    out = raw.agg(F.count("*").alias("raw_total")).join(F.broadcast(sums))  # one row each
    return out.withColumn("difference", F.col("raw_total") - F.col("canonical_total") - F.col("ambiguous_total"))


def source_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many of a's rows (day, area_id, size, price) b has, exactly, with one key relaxed, and within a day.

    Rows of both are dealt twice: by size and price, where all variants but two
    are told, and by day and area for those two. Variants of one dealing that
    share an order share its sort. A row with a null among a variant's keys has
    no match in it.
    """
    keys = ("day", "area_id", "size", "price")
    key = lambda df, n: df.select(F.col("day").cast("date").alias("day"), "area_id", F.round("size", 2).alias("size"), F.round("price", 0).alias("price"), F.lit(n).alias("in_b"))
    both = key(a, 0).unionByName(key(b, 1))
    # as text: floating numbers would be normalised by each window, and dealt anew for it
    both = kept(both.withColumns({f.name: (F.col(f.name) + F.lit(0.0)).cast("string") for f in both.schema.fields if f.dataType.typeName() in ("float", "double")}), "sides")
    found = lambda *by: F.max("in_b").over(Window.partitionBy(*by))
    days = Window.partitionBy("size", "price", "area_id").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-1, 1)
    dealings = (
        (("size", "price"), {"all": (found("size", "price", "area_id", "day"), keys), "without_day": (found("size", "price", "area_id"), keys[1:]), "within_a_day": (F.max("in_b").over(days), keys), "without_area_id": (found("size", "price", "day"), ("size", "price", "day"))}),
        (("day", "area_id"), {"without_size": (found("day", "area_id", "price"), ("day", "area_id", "price")), "without_price": (found("day", "area_id", "size"), ("day", "area_id", "size"))}),
    )
    out = None
    for by, variants in dealings:
        told = both.repartition(*by)
        for name, (hit, _) in variants.items():
            told = told.withColumn(f"_{name}", hit)
        has = lambda name, on: reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in on], F.col(f"_{name}") == 1)
        counts = told.where("in_b = 0").agg(F.count("*").alias("row_count"), *[F.count_if(has(n, on)).alias(n) for n, (_, on) in variants.items()])
        rows = counts.select("row_count", F.explode(F.create_map(*[x for n in variants for x in (F.lit(n), F.col(n))])).alias("variant", "matched")).select("variant", "row_count", "matched")
        out = rows if out is None else out.unionByName(rows)
    return out


def skip_matched_import(b: DataFrame, a: DataFrame, keys: Sequence[str]) -> DataFrame:
    """b's rows without a counterpart in a."""
    return b.join(a.select(*keys).distinct(), list(keys), "left_anti")


def multiset_equal(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: records of a multiset missing in the other, either way; copies count."""
    h = lambda df: df.groupBy(F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns])), 256).alias("h")).agg(F.count("*").alias("n"))
    both = h(a).withColumnRenamed("n", "na").join(h(b).withColumnRenamed("n", "nb"), "h", "full")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.agg(F.coalesce(F.sum(F.greatest(na - nb, F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(nb - na, F.lit(0))), F.lit(0)).alias("only_right"))


def profile_columns(rows: DataFrame, columns: Sequence[str], day: str, as_of: str, limits: Mapping[str, float] | None = None, earliest: str | None = None) -> DataFrame:
    """One row: nulls, zeros and negatives of each number column, and future-dated rows.

    With limits: rows above a column's limit, and their share in per cent to
    three decimals. With earliest: rows dated before it.
    """
    d = F.col(day).cast("date")
    aggs: list[Column] = [F.count("*").alias("row_count"), F.count_if(d > F.lit(as_of).cast("date")).alias("future_rows")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.col(c) == 0).alias(f"{c}_zero"), F.count_if(F.col(c) < 0).alias(f"{c}_negative")]
    for c, limit in (limits or {}).items():
        above = F.count_if(F.col(c) > limit)
        aggs += [above.alias(f"{c}_outliers"), _share(above, F.count("*")).alias(f"{c}_outlier_pct")]
    if earliest is not None:
        aggs.append(F.count_if(d < F.lit(earliest).cast("date")).alias("ancient_rows"))
    return rows.agg(*aggs)


def _share(part: Column, of: Column) -> Column:
    """part in per cent of a count, to three decimals; null of nothing."""
    return F.round((part * 100).cast("decimal(30,10)") / F.nullif(of, F.lit(0)), 3).cast("double")


def lines_beyond_count(rows: DataFrame, line: str, count: str) -> DataFrame:
    """One row: contract lines, those whose number is beyond the contract's count of properties, and their share in per cent."""
    beyond = F.count_if(F.col(line) > F.col(count))
    return rows.agg(F.count("*").alias("row_count"), beyond.alias("beyond"), _share(beyond, F.count("*")).alias("beyond_pct"))


def counts_by_year(rows: DataFrame, day: str) -> DataFrame:
    return rows.groupBy(F.year(day).alias("year")).agg(F.count("*").alias("row_count"))


def constant_within_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, and groups in which the value varies."""
    g = rows.groupBy(group).agg((F.min(value) != F.max(value)).alias("varies"))
    return g.agg(F.count("*").alias("groups"), F.count_if("varies").alias("varying"))


def sample_size_distribution(mart: DataFrame, entity: str, count: str = "sale_cnt") -> DataFrame:
    """One row: cells, those of 1, at least 5 and at least 20 rows, and entities with two years of history."""
    m = mart.where(F.col(count) > 0)
    n = F.col(count)
    cells = m.agg(F.count("*").alias("cells"), F.count_if(n == 1).alias("single"), F.count_if(n >= 5).alias("at_least_5"), F.count_if(n >= 20).alias("at_least_20"))
    span = m.groupBy(entity).agg((F.max("month") >= F.add_months(F.min("month"), 24)).alias("long"))
    return cells.join(F.broadcast(span.agg(F.count("*").alias("entities"), F.count_if("long").alias("two_years"))))  # one row each


def name_match_coverage(a: DataFrame, b: DataFrame, column: str = "name_en") -> DataFrame:
    """One row: distinct normalised names of a, and those found in b."""
    names = lambda df: df.select(norm_name(F.col(column)).alias("n")).where("n is not null").distinct()
    hit = names(a).join(names(b).withColumn("_h", F.lit(True)), "n", "left")
    return hit.agg(F.count("*").alias("names"), F.count("_h").alias("found"))
