"""Marts kept up to date by what changed.

Facts are held as counted values: (area, project, month, usage, value) with a
count. A change of facts is a few signed counts, the old rows taken away and the
new ones added; a change of redirects moves no counts but names the areas it
moves between. Either way the touched cells (area, month, usage) are known, and
their exact percentiles come from their counts. Only years with touched cells
are read, and only those years of the mart are written.

Counts are those of qualifying facts as reported, so redirects may change later.
A batch of changes is added once; its cells may be recomputed as often as need
be, so a run that failed between the two steps is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.layers import Layers, null_safe
from ..sources.work import drop_kept, kept
from .areas import with_canonical_area
from .marts import RENT_POINTS, SALE_POINTS, join_monthly, monthly_cells

CELL = ("area_id", "month", "usage")
_REPORTED = ("area_id", "project_id", "month", "usage", "v")


class Lookups(NamedTuple):
    """What the canonical area follows from."""

    projects: DataFrame
    evidence: DataFrame
    project_actual: DataFrame

    def canonical(self, rows: DataFrame) -> DataFrame:
        return with_canonical_area(rows, *self)


class Side(NamedTuple):
    """One kind of facts: which count, their month and value, and the mart's columns."""

    name: str
    qualifying: Callable[[DataFrame], DataFrame]
    day: str
    value: str
    points: dict[str, float]


def sale_side(qualifying: Callable[[DataFrame], DataFrame]) -> Side:
    return Side("sale", qualifying, "txn_date", "price_per_m2", SALE_POINTS)


def rent_side(qualifying: Callable[[DataFrame], DataFrame]) -> Side:
    return Side("rent", qualifying, "start_date", "rent_per_m2_year", RENT_POINTS)


def counted(facts: DataFrame, side: Side, sign: int = 1) -> DataFrame:
    """(area_id, project_id, month, usage, v, n) of the facts that qualify."""
    rows = side.qualifying(facts).select("area_id", "project_id", F.trunc(side.day, "month").alias("month"), F.coalesce("usage", F.lit("Unknown")).alias("usage"), F.col(side.value).cast("double").alias("v"))
    return rows.groupBy(*_REPORTED).agg((F.count("*") * sign).alias("n"))


def signed(changes: DataFrame, side: Side) -> DataFrame:
    """What changed rows (with ``was``, the row before, or null) add to the counts and take from them."""
    before = counted(changes.where("was is not null").select("was.*"), side, -1)
    after = counted(changes.drop("was", "action"), side)
    return before.unionByName(after).groupBy(*_REPORTED).agg(F.sum("n").alias("n")).where("n <> 0")


class AreaMart:
    """The mart by canonical area under root, with the counts that it is made of."""

    def __init__(self, spark: SparkSession, root: str, sales: Side, rents: Side, ids: str = "int"):
        self.spark, self.sides = spark, {s.name: s for s in (sales, rents)}
        counts = T.StructType.fromDDL(f"area_id {ids}, project_id bigint, month date, usage string, v double, n bigint")
        self.counts = {n: Layers(spark, f"{root}/{n}-counts", counts, _REPORTED, F.year("month"), how="sum") for n in self.sides}
        columns = f"area_id {ids}, month date, usage string, sale_cnt bigint, " + ", ".join(f"{c} double" for c in SALE_POINTS) + ", rent_cnt bigint, rent_median_annual_m2 double, gross_yield_pct double"
        self.mart = Layers(spark, f"{root}/mart", T.StructType.fromDDL(columns), CELL, F.year("month"))

    def add(self, name: str, delta: DataFrame, lookups: Lookups, stream: str, batch: int) -> None:
        """Adds signed counts of one side, once a (stream, batch), and recomputes the cells they touch."""
        layers = self.counts[name]
        delta = kept(delta.select([F.col(f.name).cast(f.dataType) for f in layers.schema.fields]), "delta")
        layers.change(lambda _: delta, stream, batch)
        self._recompute(lookups.canonical(delta.select(*_REPORTED)).select(F.col("canonical_area_id").alias("area_id"), "month", "usage").distinct(), lookups)
        drop_kept(delta)

    def redirect(self, before: Lookups, after: Lookups) -> None:
        """Recomputes the cells that rows leave or reach where redirects changed."""
        cells = []
        for layers in self.counts.values():
            where = layers.read().select("area_id", "project_id", "month", "usage").distinct()
            both = after.canonical(before.canonical(where).withColumnRenamed("canonical_area_id", "_before"))
            moved = both.where(~F.col("_before").eqNullSafe(F.col("canonical_area_id")))
            cells += [moved.select(F.col(c).alias("area_id"), "month", "usage") for c in ("_before", "canonical_area_id")]
        self._recompute(reduce(DataFrame.unionByName, cells).distinct(), after)

    def _recompute(self, touched: DataFrame, lookups: Lookups) -> None:
        touched = kept(touched, "touched")
        years = self.mart.buckets_of(touched)

        def rows(now: dict) -> DataFrame:
            parts = {}
            for name, side in self.sides.items():
                own = lookups.canonical(self.counts[name].read(years)).drop("area_id").withColumnRenamed("canonical_area_id", "area_id")
                own = own.join(touched, null_safe(own, touched, CELL), "left_semi")
                parts[name] = monthly_cells(own.groupBy(*CELL, "v").agg(F.sum("n").alias("n")), "area_id", name, side.points)
            cells = join_monthly(parts["sale"], parts["rent"], "area_id")
            old = self.mart.read(years, now)
            return old.join(touched, null_safe(old, touched, CELL), "left_anti").unionByName(cells.select([F.col(f.name).cast(f.dataType) for f in self.mart.schema.fields]))

        self.mart.replace(rows, years)
        drop_kept(touched)

    def read(self, years: Iterable[int] | None = None) -> DataFrame:
        return self.mart.read(None if years is None else [str(y) for y in years])
