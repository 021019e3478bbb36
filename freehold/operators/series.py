"""Time-series answers over marts, for all entities at once: anchors, growth, yield, year steps, rankings, chart series.

A point is one row (entity, month, usage) of a mart. "Twelve months" are the
twelve first or last usable points; ties of one month are broken by usage and
entity, so that a pooled series has a defined order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ANCHOR_MONTHS, DAYS_PER_YEAR, MIN_SAMPLE, MIN_YEARS_FOR_CAGR
from ..functions.clean import cagr_pct, half_up, pct_change
from ..sources.work import kept

#: 1970-01-01 as days since the year 1: midpoints are rounded half to even as such ordinals.
EPOCH_ORDINAL = 719_163
GROWTH_METRICS = ("capital_growth", "sale_price_m2")
METRICS = {"capital_growth": "capital_growth_cagr_pct", "gross_yield": "gross_rental_yield_pct", "total_return": "gross_total_return_pct", "sale_price_m2": "end_value_aed_m2", "rent_m2": "median_rent_aed_m2_year"}


def mask_min_sample(points: DataFrame, n: int = MIN_SAMPLE) -> DataFrame:
    """Thin values to null and count 0; the month stays."""
    out = points
    for value, count in (("sale_median_price_m2", "sale_cnt"), ("rent_median_annual_m2", "rent_cnt")):
        ok = F.coalesce(F.col(count) >= n, F.lit(False))
        out = out.withColumn(value, F.when(ok, F.col(value))).withColumn(count, F.when(ok, F.col(count)).otherwise(F.lit(0).cast("long")))
    return out


def _order(points: DataFrame, key: str) -> list[Column]:
    return [F.col("month"), F.col("usage"), *([F.col("entity_id")] if "entity_id" in points.columns and key != "entity_id" else [])]


def _cents(value: str) -> Column:
    return F.round(F.col(value).cast("decimal(20,6)") * 100).cast("double")


def _mean(value: str, count: str, where: Column) -> Column:
    """Count-weighted mean; sums are of whole hundredths, so no order of rows changes them."""
    return F.sum(F.when(where, _cents(value) * F.col(count))) / F.sum(F.when(where, F.col(count))) / 100


#: Value and count of each side, and the places from either end that placed() gives its usable points.
SALE, RENT = ("sale_median_price_m2", "sale_cnt"), ("rent_median_annual_m2", "rent_cnt")


def _usable(side: tuple[str, str]) -> Column:
    return F.col(side[0]).isNotNull() & (F.coalesce(F.col(side[1]), F.lit(0)) > 0)


def placed(points: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """points with the places of usable sale points from the first (_first) and last (_last), and of rent points from the last (_rent_last).

    The three windows and what is grouped by the same key afterwards share one
    shuffle. Places of points that aren't usable come after all others.
    """
    last = [c.desc() for c in order]
    at = lambda side, o: F.row_number().over(Window.partitionBy(*by).orderBy(_usable(side).desc(), *o))
    return points.withColumn("_first", at(SALE, order)).withColumn("_last", at(SALE, last)).withColumn("_rent_last", at(RENT, last))


#: Parts into which a pooled key's entities are dealt before their first and last points are looked for.
POOL_PARTS = 64


def pooled(points: DataFrame, key: str, months: int = ANCHOR_MONTHS) -> DataFrame:
    """Of each key the points that can be among the first or last of all its entities: at most 3 * months from each of POOL_PARTS parts."""
    near = placed(points, [F.col(key), F.pmod(F.xxhash64("entity_id"), F.lit(POOL_PARTS))], _order(points, key))
    return near.where((F.col("_first") <= months) | (F.col("_last") <= months) | (F.col("_rent_last") <= months)).drop("_first", "_last", "_rent_last")


def _anchors(months: int) -> list[Column]:
    """Aggregates over placed() points: both anchors of the sale side."""
    aggs = []
    for name, place in (("start", "_first"), ("end", "_last")):
        where = _usable(SALE) & (F.col(place) <= months)
        n = F.when(where, F.col("sale_cnt"))
        mid = (F.bround(F.sum(F.unix_date("month") * n).cast("double") / F.sum(n) + EPOCH_ORDINAL) - EPOCH_ORDINAL).cast("int")
        aggs += [_mean(*SALE, where).alias(f"{name}_value"), F.sum(n).alias(f"{name}_sample_size"), F.date_from_unix_date(mid).alias(f"{name}_midpoint"), F.count_if(where).alias(f"{name}_months")]
    return aggs


def _legs(months: int) -> list[Column]:
    """Aggregates over placed() points: the last points of either side."""
    rent, sale = _usable(RENT) & (F.col("_rent_last") <= months), _usable(SALE) & (F.col("_last") <= months)
    return [_mean(*RENT, rent).alias("_rent"), F.sum(F.when(rent, F.col("rent_cnt"))).alias("rent_sample_size"), _mean(*SALE, sale).alias("_sale"), F.sum(F.when(sale, F.col("sale_cnt"))).alias("sale_sample_size")]


def _growth() -> list[Column]:
    years = F.datediff("end_midpoint", "start_midpoint") / F.lit(DAYS_PER_YEAR)
    g = F.when(years >= MIN_YEARS_FOR_CAGR, cagr_pct(F.col("start_value"), F.col("end_value"), years))
    return [
        half_up(g).alias("capital_growth_cagr_pct"), half_up(years).alias("years"), half_up(F.col("start_value")).alias("start_value_aed_m2"), half_up(F.col("end_value")).alias("end_value_aed_m2"),
        *[F.col(f"{end}_{c}") for c in ("sample_size", "midpoint") for end in ("start", "end")], *[F.when(F.col("start_sample_size").isNotNull(), F.col(f"{end}_months")).alias(f"{end}_months") for end in ("start", "end")],
    ]


def _yields() -> list[Column]:
    known = F.col("_rent").isNotNull() & (F.col("_sale") > 0)
    return [
        half_up(F.when(known, F.col("_rent") / F.col("_sale") * 100)).alias("gross_rental_yield_pct"), half_up(F.when(known, F.col("_rent"))).alias("median_rent_aed_m2_year"), half_up(F.when(known, F.col("_sale"))).alias("median_sale_aed_m2"),
        F.coalesce("rent_sample_size", F.lit(0)).alias("rent_sample_size"), F.coalesce("sale_sample_size", F.lit(0)).alias("sale_sample_size"),
    ]


def anchor_window(points: DataFrame, key: str = "entity_id", months: int = ANCHOR_MONTHS) -> DataFrame:
    """Both anchors of each key: weighted value, sample, midpoint day and number of points."""
    return placed(points, [F.col(key)], _order(points, key)).groupBy(key).agg(*_anchors(months)).where("start_months > 0")


def capital_growth(points: DataFrame, key: str = "entity_id") -> DataFrame:
    """CAGR between the anchors' midpoints, null under a year; anchors exposed."""
    return anchor_window(points, key).select(key, *_growth())


def gross_rental_yield(points: DataFrame, key: str = "entity_id", months: int = ANCHOR_MONTHS) -> DataFrame:
    """The last usable rent points over the last usable sale points, each weighted by its own counts."""
    return placed(points, [F.col(key)], _order(points, key)).groupBy(key).agg(*_legs(months)).select(key, *_yields())


def summarize(points: DataFrame, key: str = "entity_id", months: int = ANCHOR_MONTHS) -> DataFrame:
    """Growth, yield and their sum (of rounded halves, null if one is missing), and the months covered: one pass, one shuffle."""
    span = [F.size(F.collect_set("month")).cast("long").alias("months_covered"), F.min("month").alias("month_from"), F.max("month").alias("month_to")]
    out = placed(points, [F.col(key)], _order(points, key)).groupBy(key).agg(*span, *_anchors(months), *_legs(months))
    return _total(out.select(key, "months_covered", "month_from", "month_to", *_growth(), *_yields()))


def _total(out: DataFrame) -> DataFrame:
    return out.withColumn("gross_total_return_pct", half_up(F.col("capital_growth_cagr_pct") + F.col("gross_rental_yield_pct")))


def yoy_steps(points: DataFrame, key: str = "entity_id") -> DataFrame:
    """Weighted mean of each calendar year and its change on the previous present year."""
    usable = points.where(F.col("sale_median_price_m2").isNotNull() & (F.col("sale_cnt") > 0))
    y = usable.groupBy(key, F.year("month").alias("year")).agg(_mean("sale_median_price_m2", "sale_cnt", F.lit(True)).alias("v"), F.sum("sale_cnt").alias("sample_size"))
    before = F.lag("v").over(Window.partitionBy(key).orderBy("year"))
    return y.withColumn("change", pct_change(F.col("v"), before)).select(key, "year", half_up(F.col("v")).alias("value_aed_m2"), "sample_size", half_up(F.col("change")).alias("yoy_change_pct"))


def consecutive_yoy_increases(steps: DataFrame, key: str = "entity_id") -> DataFrame:
    """Length of the run of rising years that ends at the latest."""
    last_flat = F.max(F.when(~F.coalesce(F.col("yoy_change_pct") > 0, F.lit(False)), F.col("year"))).over(Window.partitionBy(key))
    return steps.withColumn("_flat", last_flat).groupBy(key).agg(F.count_if(F.col("year") > F.coalesce("_flat", F.lit(-9999))).alias("yoy_run"))


def entity_series(mart: DataFrame, entity: str, as_of: str, usage: str | None = None, month_from: str | None = None, month_to: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Points (entity_id, month, usage, values and counts) not after as_of."""
    out = mart.where(F.col("month") <= F.lit(as_of).cast("date"))
    for value, keep in ((usage, lambda v: F.col("usage") == v), (month_from, lambda v: F.col("month") >= F.lit(v).cast("date")), (month_to, lambda v: F.col("month") <= F.lit(v).cast("date"))):
        if value is not None:
            out = out.where(keep(value))
    out = out.withColumnRenamed(entity, "entity_id")
    if ids is not None:
        out = out.join(ids.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return out.select("entity_id", "month", "usage", "sale_median_price_m2", F.coalesce("sale_cnt", F.lit(0)).alias("sale_cnt"), "rent_median_annual_m2", F.coalesce("rent_cnt", F.lit(0)).alias("rent_cnt"))


def ranking(points: DataFrame, names: DataFrame, metric: str, k: int = 10, min_sample: int = MIN_SAMPLE, descending: bool = True) -> DataFrame:
    """The k entities of the best metric, by name and id among equals, with how many were considered and excluded."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    s = summarize(mask_min_sample(points, min_sample)).withColumn("metric_value", F.col(METRICS[metric]))
    s = kept(s.join(names.select(F.col("id").alias("entity_id"), "name_en"), "entity_id"), "ranking")  # one row an entity, read for the counts and for the top
    counts = s.agg(F.count("*").alias("considered"), F.count_if(F.col("metric_value").isNull()).alias("excluded"))
    v = F.col("metric_value")
    top = s.where(v.isNotNull()).orderBy(v.desc() if descending else v.asc(), F.col("name_en").asc_nulls_last(), "entity_id").limit(k)
    place = F.row_number().over(Window.orderBy(v.desc() if descending else v.asc(), F.col("name_en").asc_nulls_last(), "entity_id"))  # k rows
    return top.select(place.alias("place"), "entity_id", "name_en", "metric_value", "capital_growth_cagr_pct", "gross_rental_yield_pct", "gross_total_return_pct", "end_sample_size", "rent_sample_size").join(F.broadcast(counts))  # one row


def building_best_usage(summary: DataFrame) -> DataFrame:
    """One row a building: the usage with most sales in the trailing year."""
    w = Window.partitionBy("building_id").orderBy(F.coalesce("sale_cnt_12m", F.lit(0)).desc(), "usage")
    return summary.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def building_ranking(summary: DataFrame, buildings: DataFrame, metric: str = "capital_growth", k: int = 10, min_sample: int = 1) -> DataFrame:
    """Growth or price level only: there is no income series at building level."""
    if metric not in GROWTH_METRICS:
        raise ValueError("buildings have no rent series: metric must be capital_growth or sale_price_m2")
    b = building_best_usage(summary)
    value = F.col("price_m2_cagr_pct") if metric == "capital_growth" else F.when(F.coalesce("sale_cnt_12m", F.lit(0)) >= min_sample, F.col("median_price_m2_12m"))
    b = b.withColumn("metric_value", value).where("metric_value is not null").join(buildings.select(F.col("id").alias("building_id"), "name_en"), "building_id")
    return b.orderBy(F.desc("metric_value"), "name_en", "building_id").limit(k).select("building_id", "name_en", "usage", "metric_value", "sample_tier")


def yield_ranking(points: DataFrame, names: DataFrame, k: int = 10, min_sample: int = MIN_SAMPLE) -> DataFrame:
    return ranking(points, names, "gross_yield", k, min_sample)


def growth_report(points: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """Per entity: summary, run of rises, year steps as JSON, and whether older codes were folded in (folded: entity_id)."""
    steps = yoy_steps(points)
    line = F.to_json(F.array_sort(F.collect_list(F.struct("year", "value_aed_m2", "sample_size", "yoy_change_pct"))))
    out = summarize(points).join(steps.groupBy("entity_id").agg(line.alias("steps_json"), F.count("*").alias("years_present")), "entity_id", "left").join(consecutive_yoy_increases(steps), "entity_id", "left")
    if folded is None:
        return out.withColumn("merged_codes", F.lit(False))
    return out.join(folded.select("entity_id", F.lit(True).alias("_m")).distinct(), "entity_id", "left").withColumn("merged_codes", F.coalesce("_m", F.lit(False))).drop("_m")


def compare_usage(points: DataFrame) -> DataFrame:
    """All entities' points of a usage pooled and summarised; no task holds all points of a usage."""
    near = placed(pooled(points, "usage"), [F.col("usage")], _order(points, "usage")).groupBy("usage").agg(*_anchors(ANCHOR_MONTHS), *_legs(ANCHOR_MONTHS))
    span = points.groupBy("usage").agg(F.size(F.collect_set("month")).cast("long").alias("months_covered"), F.min("month").alias("month_from"), F.max("month").alias("month_to"))
    return _total(span.join(near, "usage").select("usage", "months_covered", "month_from", "month_to", *_growth(), *_yields()))


def compare_entities(specs: DataFrame, areas: DataFrame, projects: DataFrame, buildings: DataFrame) -> DataFrame:
    """Specs 'type:id' next to each other; each input is a table of (id, metric columns) of its type.

    A spec that isn't type:number, or finds nothing, is a row with an error.
    """
    kind, ident = F.split("spec", ":").getItem(0), F.split("spec", ":").getItem(1)
    ok = F.col("spec").rlike("^(area|project|building):[0-9]{1,18}$")
    asked = specs.select("spec", F.when(ok, kind).alias("type"), F.when(ok, ident).try_cast("bigint").alias("id"))
    known = areas.select(F.lit("area").alias("type"), "*")
    for name, df in (("project", projects), ("building", buildings)):
        known = known.unionByName(df.select(F.lit(name).alias("type"), "*"), allowMissingColumns=True)
    known = known.withColumn("id", F.col("id").cast("bigint")).withColumn("_found", F.lit(True))
    error = F.when(F.col("type").isNull(), "malformed").when(F.col("_found").isNull(), "no match")
    return asked.join(known, ["type", "id"], "left").withColumn("error", error).drop("_found")


def best_supported_row(points: DataFrame, key: str = "entity_id", mode: str = "sales") -> DataFrame:
    """Of several usages in one month the row with the largest backing sample; a yield's is the lesser of its legs."""
    sample = {"sales": F.col("sale_cnt"), "rents": F.col("rent_cnt"), "yield": F.least("sale_cnt", "rent_cnt")}[mode]
    w = Window.partitionBy(key, "month").orderBy(F.coalesce(sample, F.lit(0)).desc(), "usage")
    return points.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fill_month_gaps(points: DataFrame, key: str = "entity_id") -> DataFrame:
    """A row for every month from the first to the last; absent months hold nulls."""
    span = points.groupBy(key).agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    grid = span.select(key, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("month"))
    return grid.join(points, [key, "month"], "left")


def month_changes(filled: DataFrame, value: str, key: str = "entity_id") -> DataFrame:
    """Change on the month before and on the month a year before, over a gap-filled series."""
    w = Window.partitionBy(key).orderBy("month")
    return filled.withColumn("mom_pct", half_up(pct_change(F.col(value), F.lag(value, 1).over(w)))).withColumn("yoy_pct", half_up(pct_change(F.col(value), F.lag(value, 12).over(w))))


def latest_point(changes: DataFrame, value: str, count: str, key: str = "entity_id") -> DataFrame:
    """The last level that isn't null, with its month, yearly change and sample."""
    p = F.max_by(F.struct(F.col("month"), F.col(value), F.col("yoy_pct"), F.col(count)), F.when(F.col(value).isNotNull(), F.col("month")))
    return changes.groupBy(key).agg(p.alias("p")).select(key, "p.*").where(F.col(value).isNotNull())


def quantile_breaks(rows: DataFrame, value: str, classes: int = 5) -> DataFrame:
    return rows.agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(i / classes) for i in range(1, classes)])).alias("breaks"))


def quantile_classes(rows: DataFrame, value: str, classes: int = 5) -> DataFrame:
    """Class 0 to classes - 1 by quantile breakpoints; null stays null, 0 is a value."""
    v = F.col(value).cast("double")
    out = rows.join(F.broadcast(quantile_breaks(rows, value, classes)))  # one row
    return out.withColumn("quantile_class", F.when(v.isNotNull(), F.size(F.filter("breaks", lambda b: v >= b)))).drop("breaks")


def minmax_scale(rows: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Linear to [lo, hi]; a flat domain gives lo."""
    v = F.col(value).cast("double")
    out = rows.join(F.broadcast(rows.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))))  # one row
    t = (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return out.withColumn("scaled", F.when(v.isNotNull(), F.coalesce(F.lit(lo) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (hi - lo), F.lit(float(lo))))).drop("_lo", "_hi")


def split_by_boundary(rows: DataFrame, boundary: str = "boundary") -> DataFrame:
    return rows.withColumn("feature_kind", F.when(F.col(boundary).isNotNull(), "polygon").otherwise("dot"))
