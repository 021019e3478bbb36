"""Monthly and summary marts: exact percentiles of a clamped set under source precedence.

Percentiles are exact. Values are first counted, so that a group's state is
(value, count) pairs combined on the map side, and a busy area's rows shrink
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    CAGR_ANCHOR_MIN_N,
    CAGR_MIN_YEARS,
    DAYS_PER_YEAR,
    PRICE_M2_MAX,
    PRICE_M2_MIN,
    RENT_HORIZON_YEARS,
    RENT_M2_MAX,
    RENT_M2_MIN,
    SALE_MIN_DATE,
    SALES_GROUP,
    TIER_STRONG_N,
    TIER_THIN_N,
)
from ..functions.clean import cagr_pct, half_up
from .areas import with_canonical_area
from .precedence import precedence_condition


def qualifying_sales(sales: DataFrame, cutover: str | None = None) -> DataFrame:
    """Sales in the plausible range, from 1990 on, that precedence lets count. All but precedence reach the scan."""
    day = F.col("txn_date")
    return sales.where((F.col("txn_group") == SALES_GROUP) & F.col("price_per_m2").between(PRICE_M2_MIN, PRICE_M2_MAX) & (day >= F.lit(SALE_MIN_DATE).cast("date")) & precedence_condition(day, cutover))


def qualifying_rents(rents: DataFrame, as_of: str, cutover: str | None = None) -> DataFrame:
    horizon = F.add_months(F.lit(as_of).cast("date"), 12 * RENT_HORIZON_YEARS)
    return rents.where(F.col("rent_per_m2_year").between(RENT_M2_MIN, RENT_M2_MAX) & F.col("start_date").isNotNull() & (F.col("start_date") <= horizon) & precedence_condition(F.col("registration_date"), cutover))


# Columns of the marts and the percentiles that they are.
SALE_POINTS = {"sale_median_price_m2": 0.5, "sale_p25_price_m2": 0.25, "sale_p75_price_m2": 0.75}
RENT_POINTS = {"rent_median_annual_m2": 0.5}


def monthly_cells(counted: DataFrame, entity: str, name: str, points: dict[str, float]) -> DataFrame:
    """Count and exact percentiles of each (entity, month, usage) from counted values (v, n)."""
    many = F.percentile("v", F.array(*[F.lit(p) for p in points.values()]), F.col("n"))
    out = counted.groupBy(entity, "month", "usage").agg(F.sum("n").alias(f"{name}_cnt"), many.alias("q"))
    return out.select(entity, "month", "usage", f"{name}_cnt", *[half_up(F.get("q", F.lit(i))).alias(c) for i, c in enumerate(points)])


def _monthly(facts: DataFrame, entity: str, day: str, value: str, name: str, points: dict[str, float]) -> DataFrame:
    keys = [F.col(entity), F.trunc(day, "month").alias("month"), F.coalesce("usage", F.lit("Unknown")).alias("usage")]
    v = F.col(value).cast("double")
    counted = facts.select(*keys, v.alias("v")).groupBy(entity, "month", "usage", "v").agg(F.count("*").alias("n"))
    return monthly_cells(counted, entity, name, points)


def sale_monthly(sales: DataFrame, entity: str) -> DataFrame:
    """Count, median and quartiles of price per m2 by entity, month and usage of qualifying sales."""
    return _monthly(sales, entity, "txn_date", "price_per_m2", "sale", SALE_POINTS)


def rent_monthly(rents: DataFrame, entity: str) -> DataFrame:
    return _monthly(rents, entity, "start_date", "rent_per_m2_year", "rent", RENT_POINTS)


def join_monthly(sales: DataFrame, rents: DataFrame, entity: str) -> DataFrame:
    """Both sides of a mart; the yield is that of the rounded medians."""
    money = lambda c: F.col(c).cast("decimal(20,2)")
    yield_pct = F.round(money("rent_median_annual_m2") / F.nullif(money("sale_median_price_m2"), F.lit(0)) * 100, 2).cast("double")
    return sales.join(rents, [entity, "month", "usage"], "full").withColumn("gross_yield_pct", yield_pct)


def area_monthly_mart(sales: DataFrame, rents: DataFrame, projects: DataFrame, evidence: DataFrame, project_actual: DataFrame) -> DataFrame:
    """By canonical area; sales and rents are qualifying facts."""
    canon = lambda f: with_canonical_area(f, projects, evidence, project_actual).drop("area_id").withColumnRenamed("canonical_area_id", "area_id")
    return join_monthly(sale_monthly(canon(sales), "area_id"), rent_monthly(canon(rents), "area_id"), "area_id")


def project_monthly_mart(sales: DataFrame, rents: DataFrame) -> DataFrame:
    has = "project_id is not null"
    return join_monthly(sale_monthly(sales.where(has), "project_id"), rent_monthly(rents.where(has), "project_id"), "project_id")


def building_base(sales: DataFrame, as_of: str) -> DataFrame:
    """(bid, usage, d, ppm) of qualifying sales with a building, not after as_of."""
    d = F.col("txn_date").cast("date")
    return sales.where(F.col("building_id").isNotNull() & (d <= F.lit(as_of).cast("date"))).select(F.col("building_id").alias("bid"), F.coalesce("usage", F.lit("Unknown")).alias("usage"), d.alias("d"), F.col("price_per_m2").cast("double").alias("ppm"))


def sample_tier(count: Column) -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.when(n >= TIER_STRONG_N, "strong").when(n >= TIER_THIN_N, "thin").otherwise("insufficient")


def building_stats(base: DataFrame, as_of: str) -> DataFrame:
    """Lifetime bounds, trailing year and both anchors of each (bid, usage), in two shuffles on that key at most.

    Bounds come from a window, then every figure is a conditional aggregate of one pass.
    """
    group = Window.partitionBy("bid", "usage")
    b = base.withColumn("first_sale", F.min("d").over(group)).withColumn("last_sale", F.max("d").over(group))
    now = F.lit(as_of).cast("date")
    recent = F.col("d") > F.add_months(now, -12)
    early, late = F.col("d") < F.add_months("first_sale", 12), F.col("d") > F.add_months("last_sale", -12)
    med = lambda c, p=0.5: F.percentile(F.when(c, F.col("ppm")), F.lit(p))
    days = F.datediff("d", F.lit("1990-01-01").cast("date"))
    mid = lambda c: F.bround(F.avg(F.when(c, days))).cast("int")
    every = F.lit(True)
    return b.groupBy("bid", "usage").agg(
        F.count("*").alias("sale_cnt_total"),
        F.min("d").alias("first_sale"),
        F.max("d").alias("last_sale"),
        half_up(med(every)).alias("median_price_m2_all"),
        F.count_if(recent).alias("n12"),
        half_up(med(recent)).alias("median_price_m2_12m"),
        half_up(med(recent, 0.25)).alias("p25_price_m2_12m"),
        half_up(med(recent, 0.75)).alias("p75_price_m2_12m"),
        F.count_if(early).alias("early_n"),
        med(early).alias("early_med"),
        mid(early).alias("early_mid"),
        F.count_if(late).alias("late_n"),
        med(late).alias("late_med"),
        mid(late).alias("late_mid"),
    )


def building_summary_mart(base: DataFrame, as_of: str) -> DataFrame:
    """One row a (building, usage): counts, medians, guarded CAGR and sample tier."""
    years = (F.col("late_mid") - F.col("early_mid")) / F.lit(DAYS_PER_YEAR)
    enough = (years >= CAGR_MIN_YEARS) & (F.col("early_n") >= CAGR_ANCHOR_MIN_N) & (F.col("late_n") >= CAGR_ANCHOR_MIN_N)
    growth = F.when(enough, cagr_pct(F.col("early_med"), F.col("late_med"), years))
    s = building_stats(base, as_of).withColumn("growth", growth).withColumn("years", years)
    given = F.col("growth").isNotNull()
    return s.select(
        F.col("bid").alias("building_id"),
        "usage",
        F.nullif("n12", F.lit(0)).alias("sale_cnt_12m"),
        "median_price_m2_12m",
        "p25_price_m2_12m",
        "p75_price_m2_12m",
        "sale_cnt_total",
        "median_price_m2_all",
        "first_sale",
        "last_sale",
        half_up(F.col("growth")).alias("price_m2_cagr_pct"),
        F.when(given, half_up(F.col("years"))).alias("cagr_years"),
        F.when(given, F.col("early_n") + F.col("late_n")).alias("cagr_sample_size"),
        sample_tier(F.col("n12")).alias("sample_tier"),
    )


def rebuild_marts(sales: DataFrame, rents: DataFrame, projects: DataFrame, evidence: DataFrame, project_actual: DataFrame, as_of: str, sale_cutover: str | None, rent_cutover: str | None) -> dict[str, DataFrame]:
    """The three marts by name, from raw facts."""
    s, r = qualifying_sales(sales, sale_cutover), qualifying_rents(rents, as_of, rent_cutover)
    return {
        "mart_area_monthly": area_monthly_mart(s, r, projects, evidence, project_actual),
        "mart_project_monthly": project_monthly_mart(s, r),
        "mart_building_summary": building_summary_mart(building_base(s, as_of), as_of),
    }


def usage_vocabulary(property_types: DataFrame) -> DataFrame:
    return property_types.where("usage is not null").groupBy("usage").agg(F.count("*").alias("property_types"))


def dataset_coverage(facts: DataFrame, name: str, day: str, low: str, high: str) -> DataFrame:
    """One row: rows, plausible date range, rows outside it. A null date is in neither."""
    d = F.col(day).cast("date")
    ok = d.between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    return facts.agg(F.count("*").alias("row_count"), F.min(F.when(ok, d)).alias("first_date"), F.max(F.when(ok, d)).alias("last_date"), F.count_if(~ok).alias("excluded")).select(F.lit(name).alias("dataset"), "*")


def coverage_report(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_month_top_areas(mart: DataFrame, areas: DataFrame, usage: str, min_sales: int = 10, k: int = 10) -> DataFrame:
    """The latest month with a cell of enough sales, and its k dearest areas."""
    cells = mart.where((F.col("usage") == usage) & (F.col("sale_cnt") >= min_sales))
    last = cells.agg(F.max("month").alias("month"))
    top = cells.join(F.broadcast(last), "month").orderBy(F.col("sale_median_price_m2").desc_nulls_last(), "area_id").limit(k)  # one month
    return top.join(areas.select(F.col("id").alias("area_id"), F.col("name_en").alias("area_name")), "area_id", "left").select("month", "area_id", "area_name", "sale_cnt", "sale_median_price_m2")


