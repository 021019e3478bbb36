"""Queries of precedence, area redirects, marts, series and listings (groups D to H and K)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas as A
from ..operators import listings as H
from ..operators import marts as M
from ..operators import precedence as P
from ..operators import quality as Q
from ..operators import series as S
from ..sources.sinks import source_table
from ..sources.snapshots import fresh_snapshot, session_dir
from . import views as V
from .registry import query
from .views import AS_OF, CUTOVER, with_

S1, D1 = SparkSession, DataFrame
MIN = 3


def kept_sales(spark: S1, sf: str) -> D1:
    return M.qualifying_sales(V.sale(spark, sf), CUTOVER)


def kept_rents(spark: S1, sf: str) -> D1:
    return M.qualifying_rents(V.rent(spark, sf), AS_OF, CUTOVER)


def area_mart(spark: S1, sf: str) -> D1:
    return M.area_monthly_mart(kept_sales(spark, sf), kept_rents(spark, sf), V.project(spark, sf), V.evidence(spark), V.project_actual(spark, sf))


def project_mart(spark: S1, sf: str) -> D1:
    return M.project_monthly_mart(kept_sales(spark, sf), kept_rents(spark, sf))


#: What marts are built from.
MART_TABLES = ("lineitem", "orders", "customer", "part", "supplier")


def stored(spark: S1, sf: str, name: str, build: Callable[[S1, str], D1]) -> D1:
    """A mart as reads find it: scanned from its snapshot, which is built anew when the tables of sf have changed."""
    root = f"{session_dir(spark)}/{hashlib.sha256(sf.encode()).hexdigest()[:16]}/{name}"
    return fresh_snapshot(spark, root, [f"{sf}/{t}.parquet" for t in MART_TABLES], lambda: build(spark, sf))


def stored_areas(spark: S1, sf: str) -> D1:
    return stored(spark, sf, "area-monthly", area_mart)


def points(spark: S1, sf: str) -> D1:
    return S.entity_series(stored_areas(spark, sf), "area_id", AS_OF)


def masked(spark: S1, sf: str) -> D1:
    return S.mask_min_sample(points(spark, sf), MIN)


# ---------------------------------------------------------------- E precedence

query("cutover_sales", with_(["sale"], f"SELECT max(txn_date::DATE) AS cutover_date FROM sale WHERE source_id = 1 AND txn_date::DATE <= DATE '{AS_OF}'"))(lambda s, d: P.cutover_sales(V.sale(s, d), AS_OF))


@query("cutover_rents", "SELECT max(strptime(regexp_extract('rents_' || strftime(o_orderdate, '%Y-%m-%d') || '_part.csv', '_(\\d{4}-\\d{2}-\\d{2})_', 1), '%Y-%m-%d'))::DATE AS cutover_date FROM orders")
def cutover_rents(s: S1, d: str) -> D1:
    names = V.table(s, d, "orders").select(F.concat(F.lit("rents_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_part.csv")).alias("file_name"))
    return P.cutover_rents(names)


query("export_date_from_filename", "SELECT max(o_orderdate::DATE) AS cutover_date FROM orders WHERE o_orderstatus = 'F'")(
    lambda s, d: P.export_date(V.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("sales_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_1.csv")).alias("file_name")))
)


@query("gateway_watermark", with_(["sale"], f"SELECT 'rents' AS endpoint, DATE '1997-01-01' AS \"cursor\" UNION ALL SELECT 'sales', max(txn_date::DATE) FROM sale WHERE source_id = 1 AND txn_date::DATE <= DATE '{AS_OF}'"))
def gateway_watermark(s: S1, d: str) -> D1:
    have = s.createDataFrame([("sales", "2020-01-01"), ("rents", "1997-01-01")], "endpoint string, cursor string").withColumn("cursor", F.to_date("cursor"))
    return P.gateway_watermark(have, "sales", P.cutover_sales(V.sale(s, d), AS_OF))


@query("apply_precedence", with_(["rent"], f"SELECT source_id, count(*) AS row_count FROM rent WHERE source_id = 1 OR registration_date > DATE '{CUTOVER}' GROUP BY 1"))
def apply_precedence(s: S1, d: str) -> D1:
    cut = s.createDataFrame([(CUTOVER,)], "c string").select(F.to_date("c").alias("cutover_date"))
    return P.apply_precedence(V.rent(s, d), "registration_date", cut).groupBy("source_id").agg(F.count("*").alias("row_count"))


# ---------------------------------------------------------------- F marts

_SIDE = "SELECT {k}, month, usage, cnt AS {n}_cnt, {m} FROM {n}_{e}"
query("sale_monthly", with_(["sale_area"], _SIDE.format(k="area_id", n="sale", e="area", m="med AS sale_median_price_m2, p25 AS sale_p25_price_m2, p75 AS sale_p75_price_m2")))(
    lambda s, d: M.sale_monthly(A.with_canonical_area(kept_sales(s, d), V.project(s, d), V.evidence(s), V.project_actual(s, d)).drop("area_id").withColumnRenamed("canonical_area_id", "area_id"), "area_id")
)
query("rent_monthly", with_(["rent_project"], _SIDE.format(k="project_id", n="rent", e="project", m="med AS rent_median_annual_m2")))(lambda s, d: M.rent_monthly(kept_rents(s, d).where("project_id is not null"), "project_id"))
query("area_monthly_mart", with_(["area_mart"], "SELECT * FROM area_mart"))(area_mart)
query("project_monthly_mart", with_(["project_mart"], "SELECT * FROM project_mart"))(project_mart)

_BASE = "base AS (SELECT building_id AS bid, coalesce(usage, 'Unknown') AS usage, txn_date::DATE AS d, fils FROM sale_kept WHERE building_id IS NOT NULL AND txn_date::DATE <= DATE '1999-06-30')"
_Q = lambda p: f"floor(quantile_cont(fils::DOUBLE, {p}) + 0.5) / 100"
_BOUNDS = f"bounds AS (SELECT bid, usage, count(*) AS n, min(d) AS lo, max(d) AS hi, {_Q(0.5)} AS med FROM base GROUP BY 1, 2)"
_RECENT = f"recent AS (SELECT bid, usage, count(*) AS n, {_Q(0.5)} AS med, {_Q(0.25)} AS p25, {_Q(0.75)} AS p75 FROM base WHERE d > DATE '1998-06-30' GROUP BY 1, 2)"
_MID = "(DATE '1990-01-01' + round_even(avg(d - DATE '1990-01-01'), 0)::INT)"
_EARLY = f"early AS (SELECT bid, usage, count(*) AS n, quantile_cont(fils::DOUBLE / 100, 0.5) AS med, {_MID} AS mid FROM base JOIN bounds b USING (bid, usage) WHERE d < b.lo + INTERVAL 12 MONTH GROUP BY 1, 2)"
_LATE = f"late AS (SELECT bid, usage, count(*) AS n, quantile_cont(fils::DOUBLE / 100, 0.5) AS med, {_MID} AS mid FROM base JOIN bounds b USING (bid, usage) WHERE d > b.hi - INTERVAL 12 MONTH GROUP BY 1, 2)"
_CAGR = "cagr AS (SELECT bid, usage, (l.mid - e.mid) / 365.25 AS years, e.n + l.n AS n, CASE WHEN (l.mid - e.mid) / 365.25 >= 2 AND e.n >= 5 AND l.n >= 5 AND e.med > 0 AND l.med > 0 THEN (power(l.med / e.med, 1.0 / ((l.mid - e.mid) / 365.25)) - 1) * 100 END AS g FROM early e JOIN late l USING (bid, usage))"
_ALL = [_BASE, _BOUNDS, _RECENT, _EARLY, _LATE, _CAGR]
_SUMMARY = """summary AS (SELECT b.bid AS building_id, b.usage, r.n AS sale_cnt_12m, r.med::DOUBLE AS median_price_m2_12m, r.p25::DOUBLE AS p25_price_m2_12m, r.p75::DOUBLE AS p75_price_m2_12m, b.n AS sale_cnt_total, b.med::DOUBLE AS median_price_m2_all, b.lo AS first_sale, b.hi AS last_sale,
  round(g::DECIMAL(20,6), 2)::DOUBLE AS price_m2_cagr_pct, CASE WHEN g IS NOT NULL THEN round(years::DECIMAL(20,6), 2)::DOUBLE END AS cagr_years, CASE WHEN g IS NOT NULL THEN c.n END AS cagr_sample_size,
  CASE WHEN coalesce(r.n, 0) >= 20 THEN 'strong' WHEN coalesce(r.n, 0) >= 5 THEN 'thin' ELSE 'insufficient' END AS sample_tier
 FROM bounds b LEFT JOIN recent r USING (bid, usage) LEFT JOIN cagr c USING (bid, usage))"""


def base(s: S1, d: str) -> D1:
    return M.building_base(kept_sales(s, d), AS_OF)


def summary(s: S1, d: str) -> D1:
    return M.building_summary_mart(base(s, d), AS_OF)


query("building_base", with_(["sale_kept"], "SELECT bid, usage, d, (fils / 100)::DOUBLE AS ppm FROM base", _BASE))(base)
query("building_bounds", with_(["sale_kept"], "SELECT bid, usage, n AS sale_cnt_total, lo AS first_sale, hi AS last_sale, med::DOUBLE AS median_price_m2_all FROM bounds", _BASE, _BOUNDS))(
    lambda s, d: M.building_stats(base(s, d), AS_OF).select("bid", "usage", "sale_cnt_total", "first_sale", "last_sale", "median_price_m2_all")
)
query("building_trailing_12m", with_(["sale_kept"], "SELECT bid, usage, n AS n12, med::DOUBLE AS median_price_m2_12m, p25::DOUBLE AS p25_price_m2_12m, p75::DOUBLE AS p75_price_m2_12m FROM recent", _BASE, _RECENT))(
    lambda s, d: M.building_stats(base(s, d), AS_OF).where("n12 > 0").select("bid", "usage", "n12", "median_price_m2_12m", "p25_price_m2_12m", "p75_price_m2_12m")
)
query(
    "building_anchors",
    with_(["sale_kept"], "SELECT e.bid, e.usage, e.n AS early_n, round(e.med, 4)::DOUBLE AS early_med, (e.mid - DATE '1990-01-01')::INT AS early_mid, l.n AS late_n, round(l.med, 4)::DOUBLE AS late_med, (l.mid - DATE '1990-01-01')::INT AS late_mid FROM early e JOIN late l USING (bid, usage)", *_ALL[:5]),
)(lambda s, d: M.building_stats(base(s, d), AS_OF).select("bid", "usage", "early_n", F.round("early_med", 4).alias("early_med"), "early_mid", "late_n", F.round("late_med", 4).alias("late_med"), "late_mid"))
#: Buildings have too few sales here for a growth rate, so these are taken fifty together.
_BLOCKS = _BASE.replace("building_id AS bid", "building_id % 40 AS bid")
query("building_cagr", with_(["sale_kept"], "SELECT building_id, usage, price_m2_cagr_pct, cagr_years, cagr_sample_size FROM summary WHERE price_m2_cagr_pct IS NOT NULL", _BLOCKS, *_ALL[1:], _SUMMARY))(
    lambda s, d: M.building_summary_mart(base(s, d).withColumn("bid", F.col("bid") % 40), AS_OF).where("price_m2_cagr_pct is not null").select("building_id", "usage", "price_m2_cagr_pct", "cagr_years", "cagr_sample_size")
)
query("building_tier", with_(["sale_kept"], "SELECT sample_tier, count(*) AS n FROM summary GROUP BY 1", *_ALL, _SUMMARY))(lambda s, d: summary(s, d).groupBy("sample_tier").agg(F.count("*").alias("n")))
query("building_summary_mart", with_(["sale_kept"], "SELECT * FROM summary", *_ALL, _SUMMARY))(summary)


@query(
    "rebuild_marts",
    with_(["area_mart", "project_mart"], "SELECT 'mart_area_monthly' AS mart, count(*) AS row_count, sum(sale_cnt)::BIGINT AS sales FROM area_mart UNION ALL SELECT 'mart_project_monthly', count(*), sum(sale_cnt)::BIGINT FROM project_mart UNION ALL SELECT 'mart_building_summary', count(*), sum(sale_cnt_total)::BIGINT FROM summary", *_ALL, _SUMMARY),
)
def rebuild_marts(s: S1, d: str) -> D1:
    marts = M.rebuild_marts(V.sale(s, d), V.rent(s, d), V.project(s, d), V.evidence(s), V.project_actual(s, d), AS_OF, CUTOVER, CUTOVER)
    parts = [m.agg(F.count("*").alias("row_count"), F.sum("sale_cnt_total" if "sale_cnt_total" in m.columns else "sale_cnt").alias("sales")).select(F.lit(n).alias("mart"), "row_count", "sales") for n, m in marts.items()]
    return M.coverage_report(parts)


query("usage_vocabulary", "SELECT p_type AS usage, count(*) AS property_types FROM (SELECT DISTINCT p_type, p_brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END FROM part) GROUP BY 1")(
    lambda s, d: M.usage_vocabulary(V.table(s, d, "part").select(F.col("p_type").alias("usage"), "p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("sub")).distinct())
)


@query(
    "coverage_report",
    with_(["sale", "rent"], "".join(
        f"{u}SELECT '{n}' AS dataset, count(*) AS row_count, min(CASE WHEN {c}::DATE BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}' THEN {c}::DATE END) AS first_date, max(CASE WHEN {c}::DATE BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}' THEN {c}::DATE END) AS last_date, count(*) FILTER (NOT ({c}::DATE BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}')) AS excluded FROM {t}"
        for u, n, c, t in (("", "sales", "txn_date", "sale"), (" UNION ALL ", "rents", "registration_date", "rent"))
    )),
)
def coverage_report(s: S1, d: str) -> D1:
    return M.coverage_report([M.dataset_coverage(V.sale(s, d), "sales", "txn_date", "1996-01-01", AS_OF), M.dataset_coverage(V.rent(s, d), "rents", "registration_date", "1996-01-01", AS_OF)])


query(
    "latest_month_top_areas",
    with_(["area_mart", "area"], "SELECT month, area_id, name_en AS area_name, sale_cnt, sale_median_price_m2 FROM area_mart m LEFT JOIN area a ON a.id = m.area_id WHERE usage = 'PROMO' AND sale_cnt >= 3 AND month = (SELECT max(month) FROM area_mart WHERE usage = 'PROMO' AND sale_cnt >= 3) ORDER BY sale_median_price_m2 DESC NULLS LAST, area_id LIMIT 10"),
)(lambda s, d: M.latest_month_top_areas(stored_areas(s, d), V.area(s, d), "PROMO", 3))

# ---------------------------------------------------------------- D redirects

_ONE = "SELECT * FROM single_successor"
_E = lambda rows, body: "WITH evidence(old_area_id, new_area_id, reviewed) AS (VALUES (3, 20, true), (7, 21, true), (7, 22, true), (9, 23, false)), " + rows + body
#: Splits are looked for among sales after the first of 1999, so that areas with a late first sale exist in the fixture.
_LATE_SALES = "late_sale AS (SELECT * FROM sale WHERE area_id % 5 <> 0 OR txn_date >= TIMESTAMP '1999-06-01')"
_CANDS = "cand AS (SELECT area_id, min(txn_date::DATE) AS first_sale FROM late_sale GROUP BY 1 HAVING min(txn_date::DATE) >= DATE '1999-06-30' - 45)"
_COUNTS = "counts AS (SELECT project_id, area_id, count(*) AS n FROM late_sale WHERE project_id IS NOT NULL GROUP BY 1, 2)"
_MINE = "mine AS (SELECT project_id, area_id AS new_area_id FROM counts WHERE area_id IN (SELECT area_id FROM cand)), tot AS (SELECT new_area_id, count(*) AS projects FROM mine GROUP BY 1)"
_MET = "met AS (SELECT new_area_id, c.area_id AS old_area_id, sum(n)::BIGINT AS txn_count, count(*) AS shared_projects FROM mine m JOIN counts c ON c.project_id = m.project_id AND c.area_id <> new_area_id GROUP BY 1, 2)"
_BEST = "best AS (SELECT m.*, projects, round(shared_projects * 100.0 / projects, 2)::DOUBLE AS overlap_pct FROM (SELECT *, row_number() OVER (PARTITION BY new_area_id ORDER BY txn_count DESC, old_area_id) AS r FROM met) m JOIN tot USING (new_area_id) WHERE r = 1)"


def late_sales(s: S1, d: str) -> D1:
    return V.sale(s, d).where("area_id % 5 <> 0 or txn_date >= timestamp '1999-06-01'")


query("candidate_new_areas", with_(["sale"], "SELECT * FROM cand", _LATE_SALES, _CANDS))(lambda s, d: A.candidate_new_areas(late_sales(s, d), AS_OF))
_DOM = "SELECT new_area_id, old_area_id, txn_count, shared_projects, projects, overlap_pct FROM best WHERE overlap_pct >= 30"
query("dominant_old_area", with_(["sale"], _DOM, _LATE_SALES, _CANDS, _COUNTS, _MINE, _MET, _BEST))(
    lambda s, d: A.dominant_old_area(late_sales(s, d), A.candidate_new_areas(late_sales(s, d), AS_OF)).select("new_area_id", "old_area_id", "txn_count", "shared_projects", "projects", F.col("overlap_pct").cast("double").alias("overlap_pct"))
)
query("detect_area_splits", with_(["sale"], "SELECT new_area_id, old_area_id, txn_count, overlap_pct, first_sale, (SELECT count(*) FROM late_sale l WHERE l.area_id = new_area_id) AS new_txn_count FROM best JOIN cand ON cand.area_id = new_area_id WHERE overlap_pct >= 30", _LATE_SALES, _CANDS, _COUNTS, _MINE, _MET, _BEST))(
    lambda s, d: A.detect_area_splits(late_sales(s, d), AS_OF).select("new_area_id", "old_area_id", "txn_count", F.col("overlap_pct").cast("double").alias("overlap_pct"), "first_sale", "new_txn_count")
)


@query("upsert_evidence", with_(["sale", "evidence"], "SELECT coalesce(e.old_area_id, b.old_area_id)::INT AS old_area_id, coalesce(e.new_area_id, b.new_area_id)::INT AS new_area_id, b.txn_count, coalesce(reviewed, false) AS reviewed FROM evidence e FULL OUTER JOIN (SELECT * FROM best WHERE overlap_pct >= 30) b ON e.old_area_id = b.old_area_id AND e.new_area_id = b.new_area_id", _LATE_SALES, _CANDS, _COUNTS, _MINE, _MET, _BEST))
def upsert_evidence(s: S1, d: str) -> D1:
    return A.upsert_evidence(V.evidence(s), A.detect_area_splits(late_sales(s, d), AS_OF).select("old_area_id", "new_area_id", "txn_count"))


@query("upsert_project_actual", "SELECT s_suppkey AS project_id, 7 AS old_area_id, CASE WHEN s_suppkey % 8 < 4 THEN 30 WHEN s_suppkey % 4 = 1 THEN 21 ELSE 22 END AS new_area_id FROM supplier WHERE s_nationkey = 7 AND (s_suppkey % 4 IN (1, 3) OR s_suppkey % 8 < 4)")
def upsert_project_actual(s: S1, d: str) -> D1:
    found = V.project(s, d).where("area_id = 7 and id % 8 < 4").select(F.col("id").alias("project_id"), F.col("area_id").alias("old_area_id"), F.lit(30).alias("new_area_id"))
    return A.upsert_project_actual(V.project_actual(s, d), found)


@query(
    "review_split",
    with_(["sale", "evidence"], "SELECT coalesce(e.old_area_id, b.old_area_id)::INT AS old_area_id, coalesce(e.new_area_id, b.new_area_id)::INT AS new_area_id, CASE WHEN b.new_area_id IS NULL THEN reviewed ELSE overlap_pct >= 90 END AS reviewed, CASE WHEN b.new_area_id IS NULL THEN 'unchanged' WHEN coalesce(reviewed, false) = (overlap_pct >= 90) THEN 'already' ELSE 'set' END AS outcome FROM evidence e FULL OUTER JOIN (SELECT * FROM best WHERE overlap_pct >= 30) b ON e.old_area_id = b.old_area_id AND e.new_area_id = b.new_area_id", _LATE_SALES, _CANDS, _COUNTS, _MINE, _MET, _BEST),
)
def review_split(s: S1, d: str) -> D1:
    """Pairs found in the sales: those of much overlap approved, the others turned down; pairs not found stay as they are."""
    found = A.detect_area_splits(late_sales(s, d), AS_OF)
    decisions = found.select("old_area_id", "new_area_id", (F.col("overlap_pct") >= 90).alias("approve"))
    return A.review_split(A.upsert_evidence(V.evidence(s), found.select("old_area_id", "new_area_id", "txn_count")).drop("txn_count"), decisions)


query("canonical_area", with_(["project", "sale", "single_successor", "project_reviewed"], "SELECT coalesce(q.new_area_id, p.area_id, s.new_area_id, f.area_id)::INT AS canonical_area_id, count(*) AS row_count FROM sale f LEFT JOIN project p ON p.id = f.project_id LEFT JOIN project_reviewed q ON q.project_id = f.project_id LEFT JOIN single_successor s ON s.old_area_id = f.area_id GROUP BY 1"))(
    lambda s, d: A.with_canonical_area(V.sale(s, d), V.project(s, d), V.evidence(s), V.project_actual(s, d)).groupBy("canonical_area_id").agg(F.count("*").alias("row_count"))
)
query("single_successor", with_(["single_successor", "sale"], "SELECT old_area_id::INT AS old_area_id, new_area_id::INT AS new_area_id, (SELECT count(*) FROM sale WHERE area_id = old_area_id) AS redirected_sales FROM single_successor"))(
    lambda s, d: A.single_successor(V.evidence(s)).join(V.sale(s, d), F.col("old_area_id") == F.col("area_id"), "left").groupBy("old_area_id", "new_area_id").agg(F.count("area_id").alias("redirected_sales"))
)
query("project_actual_reviewed", with_(["project_reviewed"], "SELECT project_id, new_area_id::INT AS new_area_id FROM project_reviewed"))(lambda s, d: A.project_actual_reviewed(V.project_actual(s, d), V.evidence(s)))
query("area_lineage", with_(["area", "single_successor"], "SELECT id, name_en, coalesce((SELECT string_agg(new_area_id::VARCHAR, ',' ORDER BY new_area_id) FROM evidence WHERE reviewed AND old_area_id = a.id), '') AS successors, coalesce((SELECT string_agg(old_area_id::VARCHAR, ',' ORDER BY old_area_id) FROM single_successor WHERE new_area_id = a.id), '') AS predecessors FROM area a"))(
    lambda s, d: A.area_lineage(V.area(s, d), V.evidence(s)).select("id", "name_en", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("successors", "predecessors")])
)


def requested(s: S1, d: str, ids: tuple[int, ...]) -> D1:
    return V.area(s, d).where(F.col("id").isin(*ids)).select(F.col("id").alias("area_id"))


_EXP = "exp AS (SELECT DISTINCT x AS area_id FROM (SELECT coalesce(s.new_area_id, a.id) AS x FROM area a LEFT JOIN single_successor s ON s.old_area_id = a.id WHERE a.id IN ({ids}) AND a.id NOT IN (SELECT old_area_id FROM evidence WHERE reviewed GROUP BY 1 HAVING count(*) > 1)) UNION SELECT old_area_id FROM single_successor WHERE new_area_id IN (SELECT coalesce(s.new_area_id, a.id) FROM area a LEFT JOIN single_successor s ON s.old_area_id = a.id WHERE a.id IN ({ids})))"


@query("expand_area_ids", with_(["area", "single_successor"], "SELECT area_id::INT AS area_id, 'ok' AS status FROM exp UNION ALL SELECT old_area_id::INT, 'ambiguous' FROM evidence WHERE reviewed AND old_area_id IN (3, 7, 10, 20) GROUP BY 1 HAVING count(*) > 1", _EXP.format(ids="3, 7, 10, 20")))
def expand_area_ids(s: S1, d: str) -> D1:
    ok, bad = A.expand_area_ids(requested(s, d, (3, 7, 10, 20)), V.evidence(s))
    return ok.select("area_id", F.lit("ok").alias("status")).unionByName(bad.select("area_id", F.lit("ambiguous").alias("status")))


@query("area_scope_filter", with_(["sale", "area", "single_successor", "project_reviewed"], "SELECT area_id, count(*) AS row_count FROM sale WHERE area_id IN (SELECT area_id FROM exp) OR project_id IN (SELECT project_id FROM project_reviewed WHERE new_area_id IN (21)) GROUP BY 1", _EXP.format(ids="21")))
def area_scope_filter(s: S1, d: str) -> D1:
    ok, _ = A.expand_area_ids(requested(s, d, (21,)), V.evidence(s))
    return A.in_area_scope(V.sale(s, d), ok, requested(s, d, (21,)), A.project_actual_reviewed(V.project_actual(s, d), V.evidence(s))).groupBy("area_id").agg(F.count("*").alias("row_count"))


query("exclude_superseded", with_(["sale", "evidence"], "SELECT area_id, count(*) AS row_count FROM sale WHERE area_id NOT IN (SELECT old_area_id FROM evidence WHERE reviewed) GROUP BY 1"))(lambda s, d: A.exclude_superseded(V.sale(s, d), V.evidence(s)).groupBy("area_id").agg(F.count("*").alias("row_count")))
query("exclude_ambiguous_old", with_(["sale", "evidence"], "SELECT area_id, count(*) AS row_count FROM sale WHERE area_id NOT IN (SELECT old_area_id FROM evidence WHERE reviewed GROUP BY 1 HAVING count(*) > 1) GROUP BY 1"))(
    lambda s, d: A.exclude_ambiguous_old(V.sale(s, d), V.evidence(s)).groupBy("area_id").agg(F.count("*").alias("row_count"))
)
query("canonical_label_join", with_(["area_mart", "area"], "SELECT coalesce(s.new_area_id, m.area_id)::INT AS canonical_area_id, a.name_en AS area_name, m.month, m.usage, m.sale_cnt FROM area_mart m LEFT JOIN single_successor s ON s.old_area_id = m.area_id LEFT JOIN area a ON a.id = coalesce(s.new_area_id, m.area_id)"))(
    lambda s, d: A.canonical_label(stored_areas(s, d), V.area(s, d), V.evidence(s)).select("canonical_area_id", "area_name", "month", "usage", "sale_cnt")
)

# ---------------------------------------------------------------- G series

_PTS = f"pts AS (SELECT area_id AS entity_id, month, usage, sale_median_price_m2 AS v, coalesce(sale_cnt, 0) AS n, rent_median_annual_m2 AS rv, coalesce(rent_cnt, 0) AS rn FROM area_mart WHERE month <= DATE '{AS_OF}')"
_MASK = f"mpts AS (SELECT entity_id, month, usage, CASE WHEN n >= {MIN} THEN v END AS v, CASE WHEN n >= {MIN} THEN n ELSE 0 END AS n, CASE WHEN rn >= {MIN} THEN rv END AS rv, CASE WHEN rn >= {MIN} THEN rn ELSE 0 END AS rn FROM pts)"


def _series_sql(key: str, pts: str = "mpts") -> list[str]:
    tie = "month, usage" + ("" if key == "entity_id" else ", entity_id")
    desc = ", ".join(f"{t.strip()} DESC" for t in tie.split(","))
    rk = lambda v, n, name: f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {tie}) AS a, row_number() OVER (PARTITION BY {key} ORDER BY {desc}) AS z FROM {pts} WHERE {v} IS NOT NULL AND {n} > 0)"
    mean = lambda v, n: f"sum(round({v} * 100)::BIGINT * {n})::DOUBLE / sum({n})::DOUBLE / 100"
    end = lambda c: f"SELECT {key}, {mean('v', 'n')} AS val, sum(n)::BIGINT AS smp, DATE '1970-01-01' + (round_even(sum((month - DATE '1970-01-01') * n)::DOUBLE / sum(n) + 719163, 0) - 719163)::INT AS mid, count(*) AS k FROM rs WHERE {c} <= 12 GROUP BY 1"
    r2 = lambda x: f"round(({x})::DECIMAL(20,6), 2)::DOUBLE"
    return [
        rk("v", "n", "rs"), rk("rv", "rn", "rr"), f"st AS ({end('a')})", f"en AS ({end('z')})",
        f"growth AS (SELECT {key}, {r2('CASE WHEN (e.mid - s.mid) / 365.25 >= 1 AND s.val > 0 AND e.val > 0 THEN (power(e.val / s.val, 1.0 / ((e.mid - s.mid) / 365.25)) - 1) * 100 END')} AS capital_growth_cagr_pct, {r2('(e.mid - s.mid) / 365.25')} AS years, {r2('s.val')} AS start_value_aed_m2, {r2('e.val')} AS end_value_aed_m2, s.smp AS start_sample_size, e.smp AS end_sample_size, s.mid AS start_midpoint, e.mid AS end_midpoint, s.k AS start_months, e.k AS end_months FROM st s JOIN en e USING ({key}))",
        f"yr AS (SELECT {key}, {mean('rv', 'rn')} AS val, sum(rn)::BIGINT AS smp FROM rr WHERE z <= 12 GROUP BY 1)",
        f"yields AS (SELECT k.{key}, {r2('CASE WHEN y.val IS NOT NULL AND e.val > 0 THEN y.val / e.val * 100 END')} AS gross_rental_yield_pct, {r2('CASE WHEN y.val IS NOT NULL AND e.val > 0 THEN y.val END')} AS median_rent_aed_m2_year, {r2('CASE WHEN y.val IS NOT NULL AND e.val > 0 THEN e.val END')} AS median_sale_aed_m2, coalesce(y.smp, 0) AS rent_sample_size, coalesce(e.smp, 0) AS sale_sample_size FROM (SELECT DISTINCT {key} FROM {pts}) k LEFT JOIN yr y USING ({key}) LEFT JOIN en e USING ({key}))",
        f"summ AS (SELECT m.*, g.* EXCLUDE ({key}), y.* EXCLUDE ({key}), {r2('capital_growth_cagr_pct + gross_rental_yield_pct')} AS gross_total_return_pct FROM (SELECT {key}, count(DISTINCT month) AS months_covered, min(month) AS month_from, max(month) AS month_to FROM {pts} GROUP BY 1) m LEFT JOIN growth g USING ({key}) LEFT JOIN yields y USING ({key}))",
    ]


_SER = [_PTS, _MASK, *_series_sql("entity_id")]
query("entity_series", with_(["area_mart"], "SELECT entity_id, month, usage, v AS sale_median_price_m2, n AS sale_cnt, rv AS rent_median_annual_m2, rn AS rent_cnt FROM pts WHERE usage = 'PROMO' AND month BETWEEN DATE '1997-01-01' AND DATE '1998-12-01'", _PTS))(
    lambda s, d: S.entity_series(stored_areas(s, d), "area_id", AS_OF, "PROMO", "1997-01-01", "1998-12-01")
)
query("mask_min_sample", with_(["area_mart"], "SELECT entity_id, month, usage, v AS sale_median_price_m2, n AS sale_cnt, rv AS rent_median_annual_m2, rn AS rent_cnt FROM mpts", _PTS, _MASK))(masked)
query("anchor_window", with_(["area_mart"], "SELECT entity_id, start_value_aed_m2, start_sample_size, start_midpoint, start_months, end_value_aed_m2, end_sample_size, end_midpoint, end_months FROM growth", *_SER))(
    lambda s, d: S.capital_growth(masked(s, d)).select("entity_id", "start_value_aed_m2", "start_sample_size", "start_midpoint", "start_months", "end_value_aed_m2", "end_sample_size", "end_midpoint", "end_months")
)
query("capital_growth", with_(["area_mart"], "SELECT * FROM growth", *_SER))(lambda s, d: S.capital_growth(masked(s, d)))
query("gross_rental_yield", with_(["area_mart"], "SELECT * FROM yields", *_SER))(lambda s, d: S.gross_rental_yield(masked(s, d)))
query("total_return", with_(["area_mart"], "SELECT * FROM summ", *_SER))(lambda s, d: S.summarize(masked(s, d)))
_YOY = """yy AS (SELECT entity_id, year(month)::INT AS year, sum(round(v * 100)::BIGINT * n)::DOUBLE / sum(n)::DOUBLE / 100 AS val, sum(n)::BIGINT AS sample_size FROM mpts WHERE v IS NOT NULL AND n > 0 GROUP BY 1, 2),
 yoy AS (SELECT entity_id, year, round(val::DECIMAL(20,6), 2)::DOUBLE AS value_aed_m2, sample_size, round(((val / nullif(lag(val) OVER (PARTITION BY entity_id ORDER BY year), 0) - 1) * 100)::DECIMAL(20,6), 2)::DOUBLE AS yoy_change_pct FROM yy)"""
_RUN = "runs AS (SELECT entity_id, count(*) FILTER (year > coalesce(flat, -9999)) AS yoy_run FROM (SELECT *, max(CASE WHEN NOT coalesce(yoy_change_pct > 0, false) THEN year END) OVER (PARTITION BY entity_id) AS flat FROM yoy) GROUP BY 1)"
query("yoy_steps", with_(["area_mart"], "SELECT * FROM yoy", _PTS, _MASK, _YOY))(lambda s, d: S.yoy_steps(masked(s, d)))
query("consecutive_yoy_increases", with_(["area_mart"], "SELECT * FROM runs", _PTS, _MASK, _YOY, _RUN))(lambda s, d: S.consecutive_yoy_increases(S.yoy_steps(masked(s, d))))


def _rank_sql(metric: str) -> str:
    cols = "row_number() OVER (ORDER BY {m} DESC, name_en, entity_id)::INT AS place, entity_id, name_en, {m} AS metric_value, capital_growth_cagr_pct, gross_rental_yield_pct, gross_total_return_pct, end_sample_size, rent_sample_size, (SELECT count(*) FROM summ JOIN area ON id = entity_id) AS considered, (SELECT count(*) FROM summ JOIN area ON id = entity_id WHERE {m} IS NULL) AS excluded"
    return with_(["area_mart", "area"], f"SELECT {cols.format(m=metric)} FROM summ JOIN area ON id = entity_id WHERE {metric} IS NOT NULL ORDER BY place LIMIT 10", *_SER)


query("ranking", _rank_sql("gross_total_return_pct"))(lambda s, d: S.ranking(points(s, d), V.area(s, d), "total_return", 10, MIN))
query("yield_ranking", _rank_sql("gross_rental_yield_pct"))(lambda s, d: S.yield_ranking(points(s, d), V.area(s, d), 10, MIN))
query("building_best_usage", with_(["sale_kept"], "SELECT building_id, usage, sale_cnt_12m FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY coalesce(sale_cnt_12m, 0) DESC, usage) AS r FROM summary) WHERE r = 1", *_ALL, _SUMMARY))(lambda s, d: S.building_best_usage(stored(s, d, "building-summary", summary)).select("building_id", "usage", "sale_cnt_12m"))
query("building_ranking", with_(["sale_kept", "building"], "SELECT building_id, name_en, usage, median_price_m2_12m AS metric_value, sample_tier FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY coalesce(sale_cnt_12m, 0) DESC, usage) AS r FROM summary) JOIN building ON id = building_id WHERE r = 1 AND sale_cnt_12m >= 2 ORDER BY metric_value DESC, name_en, building_id LIMIT 10", *_ALL, _SUMMARY))(
    lambda s, d: S.building_ranking(stored(s, d, "building-summary", summary), V.building(s, d), "sale_price_m2", 10, 2)
)
query("growth_report", with_(["area_mart"], "SELECT summ.entity_id, months_covered, capital_growth_cagr_pct, gross_rental_yield_pct, gross_total_return_pct, yoy_run, nullif((SELECT count(*) FROM yoy WHERE yoy.entity_id = summ.entity_id), 0) AS years_present, summ.entity_id IN (SELECT new_area_id FROM single_successor) AS merged_codes FROM summ LEFT JOIN runs USING (entity_id)", *_SER, _YOY, _RUN))(
    lambda s, d: S.growth_report(masked(s, d), A.single_successor(V.evidence(s)).select(F.col("new_area_id").alias("entity_id"))).select("entity_id", "months_covered", "capital_growth_cagr_pct", "gross_rental_yield_pct", "gross_total_return_pct", "yoy_run", "years_present", "merged_codes")
)
query("compare_usage", with_(["area_mart"], "SELECT * FROM summ", _PTS, _MASK, *_series_sql("usage")))(lambda s, d: S.compare_usage(masked(s, d)))


@query(
    "compare_entities",
    with_(["area_mart", "sale_kept"], "SELECT 'area:' || n_nationkey AS spec, 'area' AS type, n_nationkey::BIGINT AS id, CASE WHEN entity_id IS NULL THEN 'no match' END AS error, capital_growth_cagr_pct, gross_rental_yield_pct, NULL::VARCHAR AS sample_tier FROM nation LEFT JOIN summ ON entity_id = n_nationkey UNION ALL SELECT 'building:' || p_partkey, 'building', p_partkey, CASE WHEN building_id IS NULL THEN 'no match' END, price_m2_cagr_pct, NULL, sample_tier FROM part LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY coalesce(sale_cnt_12m, 0) DESC, usage) AS r FROM summary) b ON b.building_id = p_partkey AND r = 1 UNION ALL SELECT 'area;' || r_regionkey, NULL, NULL, 'malformed', NULL, NULL, NULL FROM region UNION ALL SELECT 'project:99999999' || r_regionkey, 'project', 999999990 + r_regionkey, 'no match', NULL, NULL, NULL FROM region", *_SER, *_ALL, _SUMMARY),
)
def compare_entities(s: S1, d: str) -> D1:
    """All areas and buildings next to each other, with specs that are malformed and ids that don't exist."""
    spec = lambda df, prefix, key: df.select(F.concat(F.lit(prefix), F.col(key)).alias("spec"))
    region = V.table(s, d, "region")
    specs = spec(V.area(s, d), "area:", "id").unionByName(spec(V.building(s, d), "building:", "id")).unionByName(spec(region, "area;", "r_regionkey")).unionByName(spec(region, "project:99999999", "r_regionkey"))
    areas = S.summarize(masked(s, d)).select(F.col("entity_id").alias("id"), "capital_growth_cagr_pct", "gross_rental_yield_pct")
    projects = S.summarize(S.entity_series(stored(s, d, "project-monthly", project_mart), "project_id", AS_OF)).select(F.col("entity_id").alias("id"), "capital_growth_cagr_pct", "gross_rental_yield_pct")
    buildings = S.building_best_usage(stored(s, d, "building-summary", summary)).select(F.col("building_id").alias("id"), F.col("price_m2_cagr_pct").alias("capital_growth_cagr_pct"), "sample_tier")
    return S.compare_entities(specs, areas, projects, buildings).select("spec", "type", "id", "error", "capital_growth_cagr_pct", "gross_rental_yield_pct", "sample_tier")


# ---------------------------------------------------------------- K chart series

_BSR = "bsr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, month ORDER BY n DESC, usage) AS r FROM pts) WHERE r = 1)"
_GRID = "grid AS (SELECT entity_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM bsr GROUP BY 1), filled AS (SELECT g.entity_id, g.month, b.v, b.n FROM grid g LEFT JOIN bsr b USING (entity_id, month))"
_CHG = "chg AS (SELECT *, round(((v / nullif(lag(v, 1) OVER w, 0) - 1) * 100)::DECIMAL(20,6), 2)::DOUBLE AS mom_pct, round(((v / nullif(lag(v, 12) OVER w, 0) - 1) * 100)::DECIMAL(20,6), 2)::DOUBLE AS yoy_pct FROM filled WINDOW w AS (PARTITION BY entity_id ORDER BY month))"


def best_rows(s: S1, d: str) -> D1:
    return S.best_supported_row(points(s, d))


def changes(s: S1, d: str) -> D1:
    return S.month_changes(S.fill_month_gaps(best_rows(s, d)), "sale_median_price_m2")


query("best_supported_row", with_(["area_mart"], "SELECT entity_id, month, usage, v AS sale_median_price_m2, n AS sale_cnt FROM bsr", _PTS, _BSR))(lambda s, d: best_rows(s, d).select("entity_id", "month", "usage", "sale_median_price_m2", "sale_cnt"))
query("fill_month_gaps", with_(["area_mart"], "SELECT entity_id, month, v AS sale_median_price_m2 FROM filled", _PTS, _BSR, _GRID))(lambda s, d: S.fill_month_gaps(best_rows(s, d)).select("entity_id", "month", "sale_median_price_m2"))
query("mom_pct", with_(["area_mart"], "SELECT entity_id, month, mom_pct, yoy_pct FROM chg", _PTS, _BSR, _GRID, _CHG))(lambda s, d: changes(s, d).select("entity_id", "month", "mom_pct", "yoy_pct"))
query("yoy_pct", with_(["area_mart"], "SELECT entity_id, count(yoy_pct) AS months_with_change, count(*) AS months FROM chg GROUP BY 1", _PTS, _BSR, _GRID, _CHG))(lambda s, d: changes(s, d).groupBy("entity_id").agg(F.count("yoy_pct").alias("months_with_change"), F.count("*").alias("months")))
query("latest_point", with_(["area_mart"], "SELECT entity_id, month, v AS sale_median_price_m2, yoy_pct, n AS sale_cnt FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) AS r FROM chg WHERE v IS NOT NULL) WHERE r = 1", _PTS, _BSR, _GRID, _CHG))(lambda s, d: S.latest_point(changes(s, d), "sale_median_price_m2", "sale_cnt"))
_LATEST = f"lam AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY month DESC, sale_cnt DESC, usage) AS r FROM area_mart WHERE month <= DATE '{AS_OF}' AND sale_cnt >= {MIN}) WHERE r = 1)"


def latest_metrics(s: S1, d: str) -> D1:
    from ..operators.places import latest_area_metrics

    return latest_area_metrics(stored_areas(s, d), AS_OF, MIN)


query("quantile_classes", with_(["area_mart"], "SELECT area_id, sale_median_price_m2, len(list_filter((SELECT quantile_cont(sale_median_price_m2, [0.2, 0.4, 0.6, 0.8]) FROM lam), lambda b: sale_median_price_m2 >= b))::INT AS quantile_class FROM lam", _LATEST))(
    lambda s, d: S.quantile_classes(latest_metrics(s, d).select("area_id", "sale_median_price_m2"), "sale_median_price_m2")
)
query("minmax_scale", with_(["area_mart"], "SELECT area_id, round(coalesce(4 + (sale_cnt - (SELECT min(sale_cnt) FROM lam))::DOUBLE / nullif((SELECT max(sale_cnt) - min(sale_cnt) FROM lam), 0) * 16, 4), 6)::DOUBLE AS scaled FROM lam", _LATEST))(
    lambda s, d: S.minmax_scale(latest_metrics(s, d).select("area_id", "sale_cnt"), "sale_cnt", 4, 20).select("area_id", F.round("scaled", 6).alias("scaled"))
)

# ---------------------------------------------------------------- H listings

_TX = "SELECT txn_number, txn_date::VARCHAR AS day, area_id, name_en AS area_name, amount_aed::DOUBLE AS amount_aed FROM sale LEFT JOIN area ON id = area_id WHERE area_id = 5 AND txn_group = 'Sales' AND txn_date >= TIMESTAMP '1998-01-01' AND txn_date <= TIMESTAMP '1999-12-31' AND fils >= 100000"


def transactions(s: S1, d: str) -> D1:
    t = H.list_transactions(V.sale(s, d), V.area(s, d), area_id=5, txn_group="Sales", date_from="1998-01-01", date_to="1999-12-31", price_min=1000)
    return t.select("txn_number", F.col("txn_date").cast("string").alias("day"), "area_id", "area_name", F.col("amount_aed").cast("double").alias("amount_aed"))


query("list_transactions", with_(["sale", "area"], _TX))(transactions)
query("list_rents", with_(["rent", "area"], "SELECT source_ref, start_date, area_id, name_en AS area_name, annual_amount_aed::DOUBLE AS annual_amount_aed FROM rent LEFT JOIN area ON id = area_id WHERE start_date <= DATE '2001-06-30' AND area_id = 5 AND usage = 'SMALL' AND start_date >= DATE '1997-01-01'"))(
    lambda s, d: H.list_rents(V.rent(s, d), V.area(s, d), "2001-06-30", area_id=5, usage="SMALL", date_from="1997-01-01").select("source_ref", "start_date", "area_id", "area_name", F.col("annual_amount_aed").cast("double").alias("annual_amount_aed"))
)
query("page_with_has_more", with_(["rent"], "SELECT source_ref, start_date, true AS has_more FROM rent ORDER BY start_date DESC, source_ref DESC LIMIT 50 OFFSET 100"))(
    lambda s, d: H.page_with_has_more(V.rent(s, d).select("source_ref", "start_date"), [F.col("start_date").desc(), F.col("source_ref").desc()], 50, 100)
)
query("count_matching", with_(["sale", "area"], f"SELECT count(*) AS total FROM ({_TX})"))(lambda s, d: H.count_matching(transactions(s, d)))
query("read_area_monthly", with_(["area_mart", "area"], "SELECT coalesce(s.new_area_id, m.area_id)::INT AS canonical_area_id, a.name_en AS area_name, month, usage, sale_cnt, sale_median_price_m2 FROM area_mart m LEFT JOIN single_successor s ON s.old_area_id = m.area_id LEFT JOIN area a ON a.id = coalesce(s.new_area_id, m.area_id) WHERE m.area_id IN (SELECT area_id FROM exp) AND (coalesce(sale_cnt, 0) >= 3 OR coalesce(rent_cnt, 0) >= 3) AND month >= DATE '1997-01-01'", _EXP.format(ids="3, 5")))(
    lambda s, d: H.read_area_monthly(stored_areas(s, d), V.area(s, d), V.evidence(s), requested(s, d, (3, 5)), 3, month_from="1997-01-01").select("canonical_area_id", "area_name", "month", "usage", "sale_cnt", "sale_median_price_m2")
)
query("read_project_monthly", with_(["project_mart", "project"], "SELECT project_id, name_en AS project_name, month, usage, sale_cnt FROM project_mart LEFT JOIN project ON id = project_id WHERE project_id IN (1, 2, 3) AND usage = 'PROMO'"))(
    lambda s, d: H.read_project_monthly(stored(s, d, "project-monthly", project_mart), V.project(s, d), V.project(s, d).where("id in (1, 2, 3)").select(F.col("id").alias("project_id")), usage="PROMO").select("project_id", "project_name", "month", "usage", "sale_cnt")
)
query("read_building_summary", with_(["sale_kept", "building"], "SELECT building_id, name_en AS building_name, area_id, usage, sale_cnt_total FROM summary LEFT JOIN building ON id = building_id WHERE sample_tier = 'insufficient' AND sale_cnt_total >= 2", *_ALL, _SUMMARY))(
    lambda s, d: H.read_building_summary(stored(s, d, "building-summary", summary), V.building(s, d), tier="insufficient", min_sample=2).select("building_id", "building_name", "area_id", "usage", "sale_cnt_total")
)
query("requested_vs_returned", with_(["area_mart", "area"], "SELECT id AS area_id, id IN (SELECT area_id FROM area_mart WHERE usage = 'PROMO') AS has_data FROM area"))(lambda s, d: H.requested_vs_returned(V.area(s, d).select(F.col("id").alias("area_id")), stored_areas(s, d).where("usage = 'PROMO'"), "area_id"))
query("list_projects", with_(["project", "project_reviewed"], "SELECT id, name_en, area_id FROM project WHERE (area_id = 21 OR id IN (SELECT project_id FROM project_reviewed WHERE new_area_id = 21)) AND NOT is_master"))(
    lambda s, d: H.list_projects(V.project(s, d), A.project_actual_reviewed(V.project_actual(s, d), V.evidence(s)), 21, False).select("id", "name_en", "area_id")
)
query("list_buildings", with_(["building", "project_reviewed"], "SELECT id, name_en, area_id FROM building WHERE area_id = 21 OR project_id IN (SELECT project_id FROM project_reviewed WHERE new_area_id = 21)"))(
    lambda s, d: H.list_buildings(V.building(s, d), A.project_actual_reviewed(V.project_actual(s, d), V.evidence(s)), 21).select("id", "name_en", "area_id")
)
query("list_developers", "SELECT DISTINCT s_nationkey AS developer_id FROM supplier")(lambda s, d: H.list_names(V.table(s, d, "supplier").select(F.col("s_nationkey").alias("developer_id")), ["developer_id"]))
query("list_property_types", "SELECT DISTINCT p_type, p_brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS subtype FROM part")(lambda s, d: H.list_names(V.table(s, d, "part").select("p_type", "p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("subtype")), ["p_type", "p_brand", "subtype"]))
@query("list_sources", with_(["rent"], "SELECT id, code, (SELECT count(*) FROM rent WHERE source_id = v.id) AS contracts FROM (VALUES (1, 'dld_gateway'), (2, 'datadubai_transactions'), (3, 'datadubai_rents'), (4, 'osm'), (5, 'datadubai_buildings'), (6, 'makani')) v(id, code)"))
def list_sources(s: S1, d: str) -> D1:
    used = V.rent(s, d).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    return H.list_names(source_table(s), ["id", "code"]).join(used, "id", "left").select("id", "code", F.coalesce("n", F.lit(0)).alias("contracts"))


_SEEK = [H.Order("registration_date", True, True), H.Order("usage"), H.Order("source_ref", True)]


@query("page_after_cursor", with_(["rent"], "SELECT source_ref, registration_date, usage, true AS has_more FROM rent ORDER BY registration_date DESC NULLS FIRST, usage NULLS LAST, source_ref DESC LIMIT 500 OFFSET 1000"))
def page_after_cursor(s: S1, d: str) -> D1:
    """The third page, sought from the second one's last cursor, which the first one's gave."""
    rows, cursor = V.rent(s, d).select("source_ref", "registration_date", "usage"), None
    for _ in range(2):
        cursor = H.next_cursor(H.page_after(rows, _SEEK, 500, cursor), _SEEK)
    return H.page_after(rows, _SEEK, 500, cursor).drop("cursor")


# ---------------------------------------------------------------- M checks

query("key_integrity", with_(["sale"], "SELECT source_id, count(*) AS row_count, count(DISTINCT txn_number) AS distinct_keys FROM sale GROUP BY 1"))(lambda s, d: Q.key_integrity(V.sale(s, d), "txn_number"))
query("seam_check", with_(["rent"], f"SELECT date_trunc('month', registration_date)::DATE AS month, count(*) FILTER (source_id = 1) AS bulk_rows, count(*) FILTER (source_id <> 1) AS gateway_rows, count(*) FILTER (source_id <> 1 AND registration_date <= DATE '{CUTOVER}') AS gateway_before_cutover FROM rent GROUP BY 1"))(
    lambda s, d: Q.seam_check(V.rent(s, d), "registration_date", CUTOVER)
)
query("mart_reconciliation", with_(["area_mart", "sale_kept"], "SELECT (SELECT count(*) FROM sale_kept) AS raw_total, sum(sale_cnt) FILTER (area_id <> 7)::BIGINT AS canonical_total, coalesce(sum(sale_cnt) FILTER (area_id = 7), 0)::BIGINT AS ambiguous_total, 0::BIGINT AS difference FROM area_mart"))(
    lambda s, d: Q.mart_reconciliation(kept_sales(s, d), stored_areas(s, d), A.ambiguous_areas(V.evidence(s)))
)
_O = "a AS (SELECT txn_date::DATE AS day, area_id, actual_area_m2::DOUBLE AS size, round(amount_aed, 0)::DOUBLE AS price, txn_number FROM sale), b AS (SELECT CASE WHEN substr(txn_number, 1, 1) = '1' THEN day + 1 ELSE day END AS day, area_id, size, CASE WHEN substr(txn_number, 1, 1) = '2' THEN price + 5 ELSE price END AS price FROM a WHERE substr(txn_number, 1, 1) <> '3')"


def _o_sql() -> str:
    keys = ("day", "area_id", "size", "price")
    part = lambda n, on: f"SELECT '{n}' AS variant, count(*) AS row_count, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE {on})) AS matched FROM a"
    eq = lambda ks: " AND ".join(f"b.{k} = a.{k}" for k in ks)
    return " UNION ALL ".join([part("all", eq(keys)), *[part(f"without_{k}", eq([x for x in keys if x != k])) for k in keys], part("within_a_day", eq(keys[1:]) + " AND b.day BETWEEN a.day - 1 AND a.day + 1")])


def overlap_sides(s: S1, d: str) -> tuple[D1, D1]:
    a = V.sale(s, d).select(F.col("txn_date").cast("date").alias("day"), "area_id", F.col("actual_area_m2").cast("double").alias("size"), F.round("amount_aed", 0).cast("double").alias("price"), F.substring("txn_number", 1, 1).alias("k"))
    b = a.where("k <> '3'").select(F.when(F.col("k") == "1", F.date_add("day", 1)).otherwise(F.col("day")).alias("day"), "area_id", "size", F.when(F.col("k") == "2", F.col("price") + 5).otherwise(F.col("price")).alias("price"), "k")
    return a, b


query("source_overlap", with_(["sale"], _o_sql(), _O))(lambda s, d: Q.source_overlap(*overlap_sides(s, d)))
query("skip_matched_import", with_(["sale"], "SELECT day, area_id, size, price FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.day = b.day AND a.area_id = b.area_id AND a.size = b.size AND a.price = b.price)", _O))(
    lambda s, d: Q.skip_matched_import(overlap_sides(s, d)[1], overlap_sides(s, d)[0], ("day", "area_id", "size", "price")).select("day", "area_id", "size", "price")
)
query("multiset_equal", with_(["sale"], "SELECT (SELECT count(*) FROM (SELECT day, area_id, size, price FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT day, area_id, size, price FROM a)) AS only_right", _O))(
    lambda s, d: Q.multiset_equal(*overlap_sides(s, d), ("day", "area_id", "size", "price"))
)
_PCT = lambda c: f"round((count(*) FILTER ({c}) * 100)::DECIMAL(30,10) / nullif(count(*), 0), 3)::DOUBLE"
query("profile_columns", with_(["rent"], f"SELECT count(*) AS row_count, count(*) FILTER (start_date > DATE '{AS_OF}') AS future_rows, count(*) FILTER (project_id IS NULL) AS project_id_null, count(*) FILTER (project_id = 0) AS project_id_zero, count(*) FILTER (project_id < 0) AS project_id_negative, count(*) FILTER (annual_amount_aed > 300000) AS annual_amount_aed_outliers, {_PCT('annual_amount_aed > 300000')} AS annual_amount_aed_outlier_pct, count(*) FILTER (actual_area_m2 > 195) AS actual_area_m2_outliers, {_PCT('actual_area_m2 > 195')} AS actual_area_m2_outlier_pct, count(*) FILTER (start_date < DATE '1995-02-01') AS ancient_rows FROM rent"))(
    lambda s, d: Q.profile_columns(V.rent(s, d), ["project_id"], "start_date", AS_OF, {"annual_amount_aed": 300_000, "actual_area_m2": 195}, "1995-02-01")
)
query("lines_beyond_count", f"SELECT count(*) AS row_count, count(*) FILTER (l_linenumber > l_quantity) AS beyond, {_PCT('l_linenumber > l_quantity')} AS beyond_pct FROM lineitem")(lambda s, d: Q.lines_beyond_count(V.table(s, d, "lineitem"), "l_linenumber", "l_quantity"))
query("counts_by_year", with_(["sale"], "SELECT year(txn_date)::INT AS year, count(*) AS row_count FROM sale GROUP BY 1"))(lambda s, d: Q.counts_by_year(V.sale(s, d), "txn_date"))
query("constant_within_group", "SELECT count(*) AS groups, count(*) FILTER (a <> b) AS varying FROM (SELECT min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY l_orderkey)")(lambda s, d: Q.constant_within_group(V.table(s, d, "lineitem"), "l_orderkey", "l_shipdate"))
query("sample_size_distribution", with_(["area_mart"], "SELECT c.*, e.* FROM (SELECT count(*) AS cells, count(*) FILTER (sale_cnt = 1) AS single, count(*) FILTER (sale_cnt >= 5) AS at_least_5, count(*) FILTER (sale_cnt >= 20) AS at_least_20 FROM area_mart WHERE sale_cnt > 0) c, (SELECT count(*) AS entities, count(*) FILTER (hi >= lo + INTERVAL 24 MONTH) AS two_years FROM (SELECT min(month) AS lo, max(month) AS hi FROM area_mart WHERE sale_cnt > 0 GROUP BY area_id)) e"))(
    lambda s, d: Q.sample_size_distribution(stored_areas(s, d), "area_id")
)
query("name_match_coverage", "WITH a AS (SELECT DISTINCT upper(trim(p_name)) AS n FROM part), b AS (SELECT DISTINCT upper(trim(p_name)) AS n FROM part WHERE p_size > 25) SELECT count(*) AS names, count(b.n) AS found FROM a LEFT JOIN b USING (n)")(
    lambda s, d: Q.name_match_coverage(V.building(s, d), V.table(s, d, "part").where("p_size > 25").select(F.concat(F.lit(" "), F.lower("p_name"), F.lit("  ")).alias("name_en")))
)
