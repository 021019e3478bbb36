"""Which source counts where two sources overlap: bulk rows always, gateway rows only past the cutover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BULK


def cutover_sales(sales: DataFrame, as_of: str, bulk: int = BULK) -> DataFrame:
    """One row: the latest bulk sale not after as_of."""
    day = F.col("txn_date").cast("date")
    return sales.where((F.col("source_id") == bulk) & (day <= F.lit(as_of).cast("date"))).agg(F.max(day).alias("cutover_date"))


def export_date(file_names: DataFrame, column: str = "file_name") -> DataFrame:
    """One row: the latest _YYYY-MM-DD_ in the names of an export's parts."""
    day = F.try_to_date(F.nullif(F.regexp_extract(column, "_(\\d{4}-\\d{2}-\\d{2})_", 1), F.lit("")), "yyyy-MM-dd")
    return file_names.agg(F.max(day).alias("cutover_date"))


def cutover_rents(file_names: DataFrame) -> DataFrame:
    """The export date itself: leases start long before and after they are registered."""
    return export_date(file_names)


def gateway_watermark(watermarks: DataFrame, endpoint: str, cutover: DataFrame) -> DataFrame:
    """The endpoint's cursor set to the export date, which may move it back."""
    new = cutover.where("cutover_date is not null").select(F.lit(endpoint).alias("endpoint"), F.col("cutover_date").alias("cursor"))
    return watermarks.join(new.select("endpoint"), "endpoint", "left_anti").select("endpoint", "cursor").unionByName(new)


def precedence_condition(axis: Column, cutover: str | None, source: str = "source_id", bulk: int = BULK) -> Column:
    """Null-safe: a gateway row without its axis date doesn't count; no cutover keeps all."""
    if cutover is None:
        return F.lit(True)
    return (F.col(source) == bulk) | F.coalesce(axis.cast("date") > F.lit(cutover).cast("date"), F.lit(False))


def apply_precedence(facts: DataFrame, axis: str, cutover: DataFrame, bulk: int = BULK) -> DataFrame:
    """facts under a one-row cutover table (no row or a null date: all rows stay)."""
    one = cutover.agg(F.max("cutover_date").alias("_cut"))
    past = F.coalesce(F.col(axis).cast("date") > F.col("_cut"), F.lit(False))
    return facts.join(F.broadcast(one)).where(F.col("_cut").isNull() | (F.col("source_id") == bulk) | past).drop("_cut")  # one row
