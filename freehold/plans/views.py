"""The property domain as views over the driver's tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import per_m2

AS_OF, CUTOVER = "1999-06-30", "1998-06-30"
USAGES = ("PROMO", "ECONOMY", "MEDIUM", "SMALL", "LARGE", "STANDARD")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sale(spark: SparkSession, sf: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Registered sales: one row a line item; with part (k, n), those of every n-th order from k on."""
    own = lambda n, key: table(spark, sf, n) if part is None else table(spark, sf, n).where(F.pmod(key, F.lit(part[1])) == part[0])
    t = lambda n: own(n, {"orders": "o_orderkey", "lineitem": "l_orderkey"}[n]) if n in ("orders", "lineitem") else table(spark, sf, n)
    # the area of an order first, so that line items are shuffled once for it
    placed = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = t("lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    area, amount = F.col("l_quantity").cast("decimal(12,2)"), F.col("l_extendedprice").cast("decimal(14,2)")
    return rows.select(
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("source_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("txn_number"),
        F.col("l_shipdate").alias("txn_date"),
        F.when(F.col("l_returnflag") == "A", "Sales").when(F.col("l_returnflag") == "R", "Mortgage").otherwise("Gifts").alias("txn_group"),
        F.col("c_nationkey").alias("area_id"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("project_id"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey")).alias("building_id"),
        F.col("p_type").alias("usage"),
        area.alias("actual_area_m2"),
        amount.alias("amount_aed"),
        per_m2(amount, area).alias("price_per_m2"),
    )


def rent(spark: SparkSession, sf: str) -> DataFrame:
    """Rent contracts: one row an order."""
    t = lambda n: table(spark, sf, n)
    rows = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.col("o_orderdate").cast("date")
    area, amount = (F.lit(10) + F.col("o_custkey") % 191).cast("decimal(12,2)"), F.col("o_totalprice").cast("decimal(14,2)")
    usage = F.get(F.array(*[F.lit(u) for u in USAGES]), (F.col("o_orderkey") % 6).cast("int"))
    return rows.select(
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("source_id"),
        F.col("o_orderkey").cast("string").alias("source_ref"),
        start.alias("start_date"),
        F.when(F.col("o_orderstatus") != "F", F.date_add(start, -30)).alias("registration_date"),
        F.col("c_nationkey").alias("area_id"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 100).alias("project_id"),
        usage.alias("usage"),
        area.alias("actual_area_m2"),
        amount.alias("annual_amount_aed"),
        per_m2(amount, area).alias("rent_per_m2_year"),
    )


def area(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name_en"), F.col("n_regionkey").alias("zone_id"))


def project(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "supplier")
    return t.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name_en"), F.col("s_nationkey").alias("area_id"), (F.col("s_suppkey") % 5 == 0).alias("is_master"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") - F.col("s_suppkey") % 5).alias("master_project_id"))


def building(spark: SparkSession, sf: str) -> DataFrame:
    """Buildings with a point; the area is that of the key."""
    t = table(spark, sf, "part")
    k = F.col("p_partkey")
    return t.select(
        k.alias("id"), F.col("p_name").alias("name_en"), (k % 25).cast("int").alias("area_id"), F.when(k % 3 != 0, k % 100).alias("project_id"), (F.lit(55.0) + (k % 1000) / F.lit(2000.0)).alias("lon"), (F.lit(25.0) + (k * 7 % 1000) / F.lit(2000.0)).alias("lat")
    )


def evidence(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(3, 20, True), (7, 21, True), (7, 22, True), (9, 23, False)], "old_area_id int, new_area_id int, reviewed boolean")


def project_actual(spark: SparkSession, sf: str) -> DataFrame:
    """project_id, old_area_id, new_area_id of the projects of area 7."""
    k = F.col("id") % 4
    new = F.when(k == 1, 21).when(k == 3, 22)
    return project(spark, sf).where("area_id = 7").select(F.col("id").alias("project_id"), F.col("area_id").alias("old_area_id"), new.alias("new_area_id")).where("new_area_id is not null")


_CENTS = "((2*cast({a}*100 AS bigint)*100 + cast({m}*100 AS bigint)) // nullif(2*cast({m}*100 AS bigint), 0))"
CTES = {
    "sale": f"""sale AS (SELECT *, {_CENTS.format(a="amount_aed", m="actual_area_m2")} AS fils FROM (
  SELECT CASE WHEN l_linestatus='F' THEN 1 ELSE 2 END AS source_id,
       concat(cast(l_orderkey AS varchar),'-',cast(l_linenumber AS varchar)) AS txn_number, l_shipdate AS txn_date,
       CASE l_returnflag WHEN 'A' THEN 'Sales' WHEN 'R' THEN 'Mortgage' ELSE 'Gifts' END AS txn_group,
       c_nationkey AS area_id, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END AS project_id,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey END AS building_id, p_type AS usage,
       cast(l_quantity AS decimal(12,2)) AS actual_area_m2, cast(l_extendedprice AS decimal(14,2)) AS amount_aed
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN part ON l_partkey=p_partkey))""",
    "rent": f"""rent AS (SELECT *, {_CENTS.format(a="annual_amount_aed", m="actual_area_m2")} AS fils FROM (
  SELECT CASE WHEN o_orderstatus='F' THEN 1 ELSE 2 END AS source_id, cast(o_orderkey AS varchar) AS source_ref, cast(o_orderdate AS date) AS start_date,
       CASE WHEN o_orderstatus='F' THEN NULL ELSE cast(o_orderdate AS date) - 30 END AS registration_date, c_nationkey AS area_id,
       CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 100 END AS project_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'SMALL' WHEN 4 THEN 'LARGE' ELSE 'STANDARD' END AS usage,
       cast(10 + o_custkey % 191 AS decimal(12,2)) AS actual_area_m2, cast(o_totalprice AS decimal(14,2)) AS annual_amount_aed
  FROM orders JOIN customer ON o_custkey=c_custkey))""",
    "area": "area AS (SELECT n_nationkey AS id, n_name AS name_en, n_regionkey AS zone_id FROM nation)",
    "project": "project AS (SELECT s_suppkey AS id, s_name AS name_en, s_nationkey AS area_id, s_suppkey % 5 = 0 AS is_master, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey - s_suppkey % 5 END AS master_project_id FROM supplier)",
    "building": "building AS (SELECT p_partkey AS id, p_name AS name_en, (p_partkey % 25)::INT AS area_id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 100 END AS project_id, 55.0::DOUBLE + (p_partkey % 1000) / 2000.0::DOUBLE AS lon, 25.0::DOUBLE + (p_partkey * 7 % 1000) / 2000.0::DOUBLE AS lat FROM part)",
    "evidence": "evidence(old_area_id, new_area_id, reviewed) AS (VALUES (3, 20, true), (7, 21, true), (7, 22, true), (9, 23, false))",
    "project_actual": "project_actual AS (SELECT s_suppkey AS project_id, s_nationkey AS old_area_id, CASE s_suppkey % 4 WHEN 1 THEN 21 WHEN 3 THEN 22 END AS new_area_id FROM supplier WHERE s_nationkey = 7 AND s_suppkey % 4 IN (1, 3))",
    "single_successor": "single_successor AS (SELECT old_area_id, max(new_area_id) AS new_area_id FROM evidence WHERE reviewed GROUP BY 1 HAVING count(*) = 1)",
    "project_reviewed": "project_reviewed AS (SELECT project_id, p.new_area_id FROM project_actual p JOIN evidence e ON e.old_area_id = p.old_area_id AND e.new_area_id = p.new_area_id WHERE reviewed)",
}
CTES["sale_kept"] = f"sale_kept AS (SELECT * FROM sale WHERE txn_group = 'Sales' AND fils BETWEEN 50000 AND 20000000 AND txn_date >= DATE '1990-01-01' AND (source_id = 1 OR txn_date::DATE > DATE '{CUTOVER}'))"
CTES["rent_kept"] = f"rent_kept AS (SELECT * FROM rent WHERE fils BETWEEN 5000 AND 2000000 AND start_date IS NOT NULL AND start_date <= DATE '{AS_OF}' + INTERVAL 2 YEAR AND (source_id = 1 OR registration_date > DATE '{CUTOVER}'))"
_CANON = "LEFT JOIN project p ON p.id = f.project_id LEFT JOIN project_reviewed q ON q.project_id = f.project_id LEFT JOIN single_successor s ON s.old_area_id = f.area_id"
_Q = lambda p, x="fils": f"(floor(quantile_cont({x}::DOUBLE, {p}) + 0.5) / 100)::DOUBLE"
for _kind, _src, _day in (("sale", "sale_kept", "txn_date"), ("rent", "rent_kept", "start_date")):
    _more = f", {_Q(0.25)} AS p25, {_Q(0.75)} AS p75" if _kind == "sale" else ""
    CTES[f"{_kind}_area"] = f"{_kind}_area AS (SELECT coalesce(q.new_area_id, p.area_id, s.new_area_id, f.area_id)::INT AS area_id, date_trunc('month', f.{_day})::DATE AS month, coalesce(usage, 'Unknown') AS usage, count(*) AS cnt, {_Q(0.5)} AS med{_more} FROM {_src} f {_CANON} GROUP BY 1, 2, 3)"
    CTES[f"{_kind}_project"] = f"{_kind}_project AS (SELECT project_id, date_trunc('month', {_day})::DATE AS month, coalesce(usage, 'Unknown') AS usage, count(*) AS cnt, {_Q(0.5)} AS med{_more} FROM {_src} WHERE project_id IS NOT NULL GROUP BY 1, 2, 3)"
_MART = "{n} AS (SELECT {k}, month, usage, s.cnt AS sale_cnt, s.med AS sale_median_price_m2, s.p25 AS sale_p25_price_m2, s.p75 AS sale_p75_price_m2, r.cnt AS rent_cnt, r.med AS rent_median_annual_m2, CASE WHEN s.med > 0 THEN ((2*round(r.med*100)::BIGINT*10000 + round(s.med*100)::BIGINT) // (2*round(s.med*100)::BIGINT)) / 100 END::DOUBLE AS gross_yield_pct FROM sale_{e} s FULL OUTER JOIN rent_{e} r USING ({k}, month, usage))"
CTES["area_mart"] = _MART.format(n="area_mart", k="area_id", e="area")
CTES["project_mart"] = _MART.format(n="project_mart", k="project_id", e="project")
_NEEDS = {
    "sale_kept": ["sale"], "rent_kept": ["rent"], "single_successor": ["evidence"], "project_reviewed": ["evidence", "project_actual"],
    "sale_area": ["project", "sale_kept", "single_successor", "project_reviewed"], "rent_area": ["project", "rent_kept", "single_successor", "project_reviewed"],
    "sale_project": ["sale_kept"], "rent_project": ["rent_kept"], "area_mart": ["sale_area", "rent_area"], "project_mart": ["sale_project", "rent_project"],
}


def with_(names: Sequence[str], body: str, *more: str) -> str:
    """body behind the CTEs named, those they need, and more of its own."""
    seen: list[str] = []

    def add(name: str) -> None:
        if name not in seen:
            for n in _NEEDS.get(name, ()):
                add(n)
            seen.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join([*(CTES[n] for n in seen), *more]) + "\n" + body
