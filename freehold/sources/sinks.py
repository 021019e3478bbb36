"""Writing facts, marts, snapshots and run reports as Parquet or JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import kept

# Sources by code, with name, address, licence and whether a government publishes them.
SOURCES = (
    ("dld_gateway", "Dubai Land Department open data", "https://dubailand.gov.ae/en/open-data/real-estate-data/", "Dubai open data; attribution to Dubai Land Department", True),
    ("datadubai_transactions", "data.dubai — DLD real estate transactions", "https://data.dubai/en/l/470061", "Dubai open data; attribution to Dubai Land Department", True),
    ("datadubai_rents", "data.dubai — DLD rent contracts (Ejari)", "https://data.dubai/en/l/468586", "Dubai open data; attribution to Dubai Land Department", True),
    ("osm", "OpenStreetMap (via Nominatim)", "https://www.openstreetmap.org/copyright", "ODbL — Open Database License; (c) OpenStreetMap contributors", False),
    ("datadubai_buildings", "data.dubai — DLD building register", "https://data.dubai/en/l/459613", "Dubai open data; attribution to Dubai Land Department", True),
    ("makani", "Makani — Dubai official addressing (find-place, Google-backed)", "https://www.makani.ae/", "Makani public find-place service; Google Places-derived", False),
)


def source_table(spark: SparkSession, stored: DataFrame | None = None) -> DataFrame:
    """(id, code, name, base_url, license, is_government): stored rows as they are, and the known sources that they lack, numbered on."""
    known = spark.createDataFrame([(i, *s) for i, s in enumerate(SOURCES, 1)], "n int, code string, name string, base_url string, license string, is_government boolean")
    if stored is None:
        return known.withColumnRenamed("n", "id")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = known.join(stored.select("code"), "code", "left_anti").withColumn("place", F.row_number().over(Window.orderBy("n"))).join(F.broadcast(top))  # six rows and one
    return stored.unionByName(new.withColumn("id", (F.col("top") + F.col("place")).cast(stored.schema["id"].dataType)).select(stored.columns))


#: Bits of each dimension of the order in which facts are laid out, so 2**RANK_BITS ranks each.
RANK_BITS = 6


def morton(ranks: Sequence[Column], bits: int = RANK_BITS) -> Column:
    """The ranks' bits dealt out in turn, highest first: what is near in all of them is near in this order."""
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        for i, r in enumerate(ranks):
            bit = F.shiftright(r, b).bitwiseAND(F.lit(1)).cast("bigint")
            out = out.bitwiseOR(F.shiftleft(bit, b * len(ranks) + len(ranks) - 1 - i))
    return out


def _ranks(rows: DataFrame, columns: dict[str, Column], bits: int) -> list[Column]:
    """Each value's rank among 2**bits of about as many rows each; nulls are first. Bounds are some dozen numbers a column."""
    shares = F.array(*[F.lit(k / 2**bits) for k in range(1, 2**bits)])
    bounds = rows.agg(*[F.percentile_approx(c, shares, F.lit(10_000)).alias(n) for n, c in columns.items()]).first()
    return [_rank(c, sorted(set(bounds[n] or ()))) for n, c in columns.items()]


def _rank(c: Column, steps: Sequence[float], least: int = 0) -> Column:
    """least and the number of rising steps below c, by halving; a null is below all."""
    if not steps:
        return F.lit(least)
    half = len(steps) // 2
    return F.when(c > F.lit(steps[half]), _rank(c, steps[half + 1 :], least + half + 1)).otherwise(_rank(c, steps[:half], least))


def write_facts(facts: DataFrame, path: str, day: str, entities: Sequence[str] = ("area_id", "project_id"), files: int | None = None) -> None:
    """Facts by year of the axis date, laid out so that filters on any one of the entities, or the date, skip files and row groups.

    Rows follow a Morton order of the ranks of the entities and the date, in
    ranges of it, so each file has a narrow span of every dimension, and its
    statistics say so. One sort by (entity, date) would serve one entity only.
    files: how many in all; by default what Spark's partition sizes make.
    """
    columns = {c: F.col(c).cast("double") for c in entities} | {"_day": F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")}
    facts = kept(facts, "facts")  # read for bounds, for ranges, and to be laid out
    out = facts.withColumn("year", F.year(day)).withColumn("_z", morton(_ranks(facts, columns, RANK_BITS)))
    keys = ["year", "_z"]
    ranged = out.repartitionByRange(files, *keys) if files else out.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys, *entities, day).drop("_z").write.mode("overwrite").partitionBy("year").parquet(path)


def snapshot_row(table: DataFrame) -> DataFrame:
    """A table for export: decimals as doubles, dates and times as ISO text, nested columns as JSON."""
    cols = []
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return table.select(*cols)


def export_snapshot(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    for name, table in tables.items():
        snapshot_row(table).write.mode("overwrite").format(fmt).save(f"{root}/{name}")


def run_report(steps: DataFrame, kind: str, started: str, finished: str, status: str, attempts: int = 1) -> DataFrame:
    """One row a run, the counts of its steps (step, n) as JSON."""
    report = steps.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "n"))))).alias("report"))
    return report.select(F.lit(kind).alias("kind"), F.lit(started).cast("timestamp").alias("started_at"), F.lit(finished).cast("timestamp").alias("finished_at"), F.lit(status).alias("status"), F.lit(attempts).alias("attempts"), "report")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, and of staging tables those not processed yet."""
    parts = []
    for name, t in tables.items():
        left = F.count_if(F.col("processed_at").isNull()) if "processed_at" in t.columns else F.lit(None).cast("bigint")
        parts.append(t.agg(F.count("*").alias("row_count"), left.alias("unprocessed")).select(F.lit(name).alias("table_name"), "row_count", "unprocessed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
