"""Filtered listings with a total order, one page at a time, and how they are matched to what was asked."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .areas import canonical_label, expand_area_ids

MAX_PAGE = 1000
SELECTIVE = ("area_id", "project_id", "building_id", "date_from")


def _conditions(filters: Mapping[str, object], rules: Mapping[str, Column]) -> list[Column]:
    unknown = set(filters) - set(rules)
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    return [rules[k] for k, v in filters.items() if v is not None]


def list_transactions(sales: DataFrame, areas: DataFrame, **filters) -> DataFrame:
    """Sales under the given filters with their areas' names, newest first by (date, number).

    One of area_id, project_id, building_id and date_from is required. date_to
    is compared with midnight, so later hours of that day are out.
    """
    if not any(filters.get(k) is not None for k in SELECTIVE):
        raise ValueError(f"one of {', '.join(SELECTIVE)} is required")
    v = {k: F.lit(x) for k, x in filters.items() if x is not None}
    c = F.col
    g = lambda k: v.get(k, F.lit(None))
    rules = {
        "area_id": c("area_id") == g("area_id"), "project_id": c("project_id") == g("project_id"), "building_id": c("building_id") == g("building_id"), "source_id": c("source_id") == g("source_id"),
        "txn_group": c("txn_group") == g("txn_group"), "usage": c("usage") == g("usage"), "date_from": c("txn_date") >= g("date_from").cast("timestamp"), "date_to": c("txn_date") <= g("date_to").cast("timestamp"),
        "amount_min": c("amount_aed") >= g("amount_min"), "amount_max": c("amount_aed") <= g("amount_max"), "area_min": c("actual_area_m2") >= g("area_min"), "area_max": c("actual_area_m2") <= g("area_max"),
        "price_min": c("price_per_m2") >= g("price_min"), "price_max": c("price_per_m2") <= g("price_max"),
    }
    out = sales
    for condition in _conditions(filters, rules):
        out = out.where(condition)
    return out.join(areas.select(F.col("id").alias("area_id"), F.col("name_en").alias("area_name")), "area_id", "left")


def list_rents(rents: DataFrame, areas: DataFrame, horizon: str, **filters) -> DataFrame:
    """Rents under the given filters that start by the horizon; New and Renew are stored words, matched as they are."""
    v = {k: F.lit(x) for k, x in filters.items() if x is not None}
    c = F.col
    g = lambda k: v.get(k, F.lit(None))
    rules = {
        "area_id": c("area_id") == g("area_id"), "project_id": c("project_id") == g("project_id"), "source_id": c("source_id") == g("source_id"), "usage": c("usage") == g("usage"),
        "date_from": c("start_date") >= g("date_from").cast("date"), "date_to": c("start_date") <= g("date_to").cast("date"), "amount_min": c("annual_amount_aed") >= g("amount_min"), "amount_max": c("annual_amount_aed") <= g("amount_max"), "area_min": c("actual_area_m2") >= g("area_min"),
    }
    out = rents.where(c("start_date") <= F.lit(horizon).cast("date"))
    for condition in _conditions(filters, rules):
        out = out.where(condition)
    return out.join(areas.select(F.col("id").alias("area_id"), F.col("name_en").alias("area_name")), "area_id", "left")


def page_with_has_more(rows: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in a total order; has_more says whether a further row exists. No count is taken."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE} and offset not negative")
    got = rows.orderBy(*order).offset(offset).limit(limit + 1)
    w = Window.orderBy(*order)  # a page's rows
    return got.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_n") <= limit).drop("_n")


class Order(NamedTuple):
    """One column of a total order."""

    column: str
    descending: bool = False
    nulls_first: bool = False

    def sort(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def reversed(self) -> Order:
        return Order(self.column, not self.descending, not self.nulls_first)

    def after(self, value: Column | None, or_at: bool = False) -> Column:
        """Rows after a value in this column (or at it); value None is the null."""
        c = F.col(self.column)
        if value is None:
            rest = F.lit(True) if self.nulls_first or or_at else F.lit(False)
            return rest if or_at and self.nulls_first else (c.isNotNull() if self.nulls_first else (c.isNull() & rest))
        beyond = (c <= value if or_at else c < value) if self.descending else (c >= value if or_at else c > value)
        return beyond if self.nulls_first else beyond | c.isNull()


def _signature(order: Sequence[Order]) -> str:
    return ",".join(f"{o.column}{'-' if o.descending else '+'}{'^' if o.nulls_first else '_'}" for o in order)


def page_after(rows: DataFrame, order: Sequence[Order], limit: int = 100, cursor: str | None = None) -> DataFrame:
    """One page in a total order (its columns together are unique), from where a cursor stands; with has_more and ``cursor``.

    Each row's cursor stands right after it; the last one's asks for the next
    page. Rows before a cursor are filtered away, the first column's bound by
    the scan itself, and not sorted and skipped: page 10,000 costs what page 1
    does. A cursor is the row's values of the order as text, for this order only.
    """
    if not 1 <= limit <= MAX_PAGE or not order:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}, and the order have a column")
    out = rows
    if cursor is not None:
        signature, *texts = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        if signature != _signature(order) or len(texts) != len(order):
            raise ValueError("the cursor belongs to another order")
        values = [None if t is None else F.lit(t).cast(rows.schema[o.column].dataType) for o, t in zip(order, texts, strict=True)]
        seek, same = F.lit(False), F.lit(True)
        for o, v in zip(order, values, strict=True):
            seek = seek | (same & o.after(v))
            same = same & (F.col(o.column).isNull() if v is None else F.col(o.column) == v)
        out = rows.where(order[0].after(values[0], or_at=True)).where(seek)
    keys = [F.col(o.column).cast("string") for o in order]
    told = F.replace(F.replace(F.base64(F.encode(F.to_json(F.array(F.lit(_signature(order)), *keys)), "UTF-8")), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    sort = [o.sort() for o in order]
    got = out.orderBy(*sort).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*sort))  # a page's rows
    numbered = got.withColumn("_n", place)
    more = F.max("_n").over(Window.partitionBy(F.lit(1))) > limit
    return numbered.withColumn("has_more", more).where(F.col("_n") <= limit).drop("_n").withColumn("cursor", told)


def next_cursor(page: DataFrame, order: Sequence[Order]) -> str | None:
    """The cursor of a page's last row; None of an empty page."""
    last = page.orderBy(*[o.reversed().sort() for o in order]).first()
    return None if last is None else last["cursor"]


def count_matching(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def read_area_monthly(mart: DataFrame, areas: DataFrame, evidence: DataFrame, ids: DataFrame, min_sample: int = 0, usage: str | None = None, month_from: str | None = None, month_to: str | None = None) -> DataFrame:
    """Mart rows of the requested areas, redirected and with older codes folded in, under canonical labels."""
    wanted, _ = expand_area_ids(ids, evidence)
    out = _monthly_filters(mart.join(wanted, "area_id", "left_semi"), min_sample, usage, month_from, month_to)
    return canonical_label(out, areas, evidence)


def _monthly_filters(mart: DataFrame, min_sample: int, usage: str | None, month_from: str | None, month_to: str | None) -> DataFrame:
    out = mart
    if min_sample:
        out = out.where((F.coalesce("sale_cnt", F.lit(0)) >= min_sample) | (F.coalesce("rent_cnt", F.lit(0)) >= min_sample))
    if usage is not None:
        out = out.where(F.col("usage") == usage)
    if month_from is not None:
        out = out.where(F.col("month") >= F.lit(month_from).cast("date"))
    return out if month_to is None else out.where(F.col("month") <= F.lit(month_to).cast("date"))


def read_project_monthly(mart: DataFrame, projects: DataFrame, ids: DataFrame, min_sample: int = 0, usage: str | None = None, month_from: str | None = None, month_to: str | None = None) -> DataFrame:
    out = mart.join(ids.select("project_id").distinct(), "project_id", "left_semi")
    out = _monthly_filters(out, min_sample, usage, month_from, month_to)
    return out.join(projects.select(F.col("id").alias("project_id"), F.col("name_en").alias("project_name")), "project_id", "left")


def read_building_summary(summary: DataFrame, buildings: DataFrame, usage: str | None = None, tier: str | None = None, min_sample: int = 0) -> DataFrame:
    out = summary
    for column, value in (("usage", usage), ("sample_tier", tier)):
        if value is not None:
            out = out.where(F.col(column) == value)
    out = out.where(F.col("sale_cnt_total") >= min_sample)
    return out.join(buildings.select(F.col("id").alias("building_id"), F.col("name_en").alias("building_name"), "area_id"), "building_id", "left")


def requested_vs_returned(asked: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Each distinct id asked for, and whether the whole result holds it."""
    have = rows.select(column).distinct().withColumn("_h", F.lit(True))
    return asked.select(column).distinct().join(have, column, "left").select(column, F.coalesce("_h", F.lit(False)).alias("has_data"))


def geo_filter(rows: DataFrame, has_geo: bool | None = None, level: str | None = None) -> DataFrame:
    """By presence of a point (lon) or polygon (boundary); a level wins over the flag."""
    located = F.col("lon").isNotNull()
    bounded = F.col("boundary").isNotNull() if "boundary" in rows.columns else F.lit(False)
    if level == "point":
        return rows.where(located)
    if level == "polygon":
        return rows.where(bounded)
    if has_geo is None:
        return rows
    return rows.where(located | bounded) if has_geo else rows.where(~(located | bounded))


def list_areas(areas: DataFrame, has_geo: bool | None = None, search: str | None = None) -> DataFrame:
    out = geo_filter(areas, has_geo)
    if search:
        out = out.where(F.lower("name_en").contains(search.lower()))
    return out.withColumn("has_geo", F.col("lon").isNotNull()).withColumn("has_boundary", F.col("boundary").isNotNull())


def in_area(rows: DataFrame, area_id: int, redirected: DataFrame, project_column: str) -> DataFrame:
    """Rows of the area as stored, or whose project is redirected to it (redirected: project_id, new_area_id)."""
    hit = redirected.where(F.col("new_area_id") == area_id).select(F.col("project_id").alias("_p")).distinct()
    out = rows.join(hit, F.col(project_column) == F.col("_p"), "left")
    return out.where((F.col("area_id") == area_id) | F.col("_p").isNotNull()).drop("_p")


def list_projects(projects: DataFrame, redirected: DataFrame, area_id: int | None = None, is_master: bool | None = None) -> DataFrame:
    out = projects if area_id is None else in_area(projects, area_id, redirected, "id")
    return out if is_master is None else out.where(F.col("is_master") == is_master)


def list_buildings(buildings: DataFrame, redirected: DataFrame, area_id: int | None = None, project_id: int | None = None) -> DataFrame:
    out = buildings if area_id is None else in_area(buildings, area_id, redirected, "project_id")
    return out if project_id is None else out.where(F.col("project_id") == project_id)


def list_names(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Small listings: developers, property types, sources."""
    return rows.select(*columns).distinct()
