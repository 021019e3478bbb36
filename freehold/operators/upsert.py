"""Keyed, replay-safe loading: staging dedupe, natural keys, guarded upserts and dimension creation.

A Parquet table has no merge: an upsert is a full outer join on the null-safe
key, a column-wise choice, and a rewrite. Nulls are equal in every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import kept

SALE_KEY = ("source_id", "txn_number", "txn_date", "actual_area_m2")
RENT_KEY = ("source_id", "source_ref")
#: What an update may change, by source; keys and provenance never are. A rent's size is a value, a sale's is key.
UPDATE_COLUMNS = {
    "gateway_sale": ("txn_group", "area_id", "project_id", "usage", "amount_aed"),
    "bulk_sale": ("txn_group", "area_id", "project_id", "usage", "amount_aed", "building_id"),
    "gateway_rent": ("start_date", "registration_date", "area_id", "project_id", "usage", "actual_area_m2", "annual_amount_aed"),
    "bulk_rent": ("start_date", "area_id", "project_id", "usage", "actual_area_m2", "annual_amount_aed"),
}
BUILDING_UPDATE_COLUMNS = ("project_id", "name_ar", "built_up_area", "floors", "flats", "offices", "shops", "car_parks", "elevators", "swimming_pools", "is_free_hold", "rooms_en")


def _null_safe(keys: Sequence[str], left: str = "s", right: str = "i") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def stage_dedupe(incoming: DataFrame, staged: DataFrame, key: str = "record_hash") -> DataFrame:
    """Incoming rows whose content isn't staged yet, once each."""
    return incoming.dropDuplicates([key]).join(staged.select(key), key, "left_anti")


def dedupe_natural_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given total order; null keys are keys."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def guarded_upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], update: Sequence[str], was: bool = False) -> DataFrame:
    """Stored and new rows with ``action``: insert, update (an update column really differs) or keep.

    Other columns of a stored row stay. Incoming has one row a key. With was, also
    the stored row as it was, a struct (null for an insert), of the same join.
    """
    s, i = stored.withColumn("_s", F.lit(True)).alias("s"), incoming.withColumn("_i", F.lit(True)).alias("i")
    changed = F.lit(False)
    for c in update:
        changed = changed | ~F.col(f"s.{c}").eqNullSafe(F.col(f"i.{c}"))
    new, both = F.col("s._s").isNull(), F.col("s._s").isNotNull() & F.col("i._i").isNotNull()
    action = F.when(new, "insert").when(both & changed, "update").otherwise("keep")
    pick = [F.when(new | (F.col("i._i").isNotNull() & F.lit(c in update)), F.col(f"i.{c}") if c in incoming.columns else F.lit(None)).otherwise(F.col(f"s.{c}")).alias(c) for c in stored.columns]
    old = [F.when(~new, F.struct(*[F.col(f"s.{c}").alias(c) for c in stored.columns])).alias("was")] if was else []
    return s.join(i, _null_safe(key), "full").select(*pick, action.alias("action"), *old)


def written_counts(upserted: DataFrame) -> DataFrame:
    return upserted.agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "update").alias("updated"), F.count_if(F.col("action") == "keep").alias("kept"))


#: New rows of a table from which numbering deals them over ranges; below, one task orders them.
NUMBER_ROWS = 100_000


def assign_ids(existing: DataFrame, new: DataFrame, order: Sequence[Column]) -> DataFrame:
    """existing and new rows with ids for the new: the largest id plus their place.

    The new rows are written once, dealt over ranges of the order; each range's
    rows are numbered by themselves and raised by the counts of those before.
    """
    names = [f"_o{i}" for i in range(len(order))]
    new = kept(new.withColumns(dict(zip(names, order, strict=True))), "new")
    ranges = -(-new.count() // NUMBER_ROWS)
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    if ranges > 1:
        dealt = kept(new.repartitionByRange(ranges, *names).withColumn("_part", F.spark_partition_id()), "dealt")
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = dealt.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))  # one row a range
        new = dealt.join(F.broadcast(starts), "_part")
        place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    else:
        place = F.row_number().over(Window.orderBy(*names))
    numbered = new.withColumn("_n", place).join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n"))  # one row
    return existing.unionByName(numbered.select(*[F.col(c).cast(existing.schema[c].dataType) if c in numbered.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns]))


def _firsts(rows: DataFrame, key: Sequence[str], values: Sequence[str], seq: str) -> DataFrame:
    """One row a key: its first place, and the first value that isn't null of each other column."""
    return rows.groupBy(*key).agg(F.min(seq).alias("_seq"), *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(seq))).alias(v) for v in values])


def dim_area_get_or_create(areas: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """areas with the names of rows (name_en, name_ar) that it lacked; the first Arabic name seen is kept."""
    new = _firsts(rows.where("name_en is not null"), ["name_en"], ["name_ar"], seq).join(areas.select("name_en"), "name_en", "left_anti")
    return assign_ids(areas, new, [F.col("_seq"), F.col("name_en")])


def dim_ptype_get_or_create(types: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(usage, prop_type, prop_subtype): nothing when usage and type are both missing, else 'Unknown' fills; the subtype may be null."""
    known = rows.where("usage is not null or prop_type is not null").select(F.coalesce("usage", F.lit("Unknown")).alias("usage"), F.coalesce("prop_type", F.lit("Unknown")).alias("prop_type"), "prop_subtype", seq)
    keys = ["usage", "prop_type", "prop_subtype"]
    new = known.groupBy(*keys).agg(F.min(seq).alias("_seq")).alias("s").join(types.select(*keys).alias("i"), _null_safe(keys), "left_anti")
    return assign_ids(types, new, [F.col("_seq"), *[F.col(k) for k in keys]])


def dim_project_get_or_create(projects: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """rows: project_en, project_ar, master_en, area_id. Masters are created first, as stubs, then children linked to them."""
    base = projects.select("id", "name_en", "is_master", "name_ar", "area_id", "master_project_id")
    masters = rows.where("master_en is not null").groupBy(F.col("master_en").alias("name_en")).agg(F.min(seq).alias("_seq")).withColumn("is_master", F.lit(True))
    with_masters = assign_ids(base, masters.join(base.where("is_master").select("name_en"), "name_en", "left_anti"), [F.col("_seq"), F.col("name_en")])
    kids = _firsts(rows.where("project_en is not null").withColumnRenamed("project_en", "name_en").withColumnRenamed("project_ar", "name_ar"), ["name_en"], ["name_ar", "area_id", "master_en"], seq)
    kids = kids.join(with_masters.where("not is_master").select("name_en"), "name_en", "left_anti")
    ids = with_masters.where("is_master").select(F.col("name_en").alias("master_en"), F.col("id").alias("master_project_id"))
    kids = kids.join(ids, "master_en", "left").withColumn("is_master", F.lit(False))
    return assign_ids(with_masters, kids, [F.col("_seq"), F.col("name_en")])


def dim_developer_get_or_create(developers: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """By number, named '#number' if nameless; rows without a number are one developer a name."""
    numbered = _firsts(rows.where("number is not null"), ["number"], ["name_en"], seq).join(developers.where("number is not null").select("number"), "number", "left_anti")
    numbered = numbered.withColumn("name_en", F.coalesce("name_en", F.concat(F.lit("#"), F.col("number").cast("string"))))
    named = rows.where("number is null and name_en is not null").groupBy("name_en").agg(F.min(seq).alias("_seq")).join(developers.where("number is null").select("name_en"), "name_en", "left_anti")
    new = numbered.unionByName(named, allowMissingColumns=True)
    return assign_ids(developers, new, [F.col("_seq"), F.col("name_en")])


def dim_building_get_or_create(buildings: DataFrame, rows: DataFrame, canonical: DataFrame, seq: str = "seq") -> DataFrame:
    """By name and canonical area (canonical: area_id -> canon); a new building stores the area as first reported."""
    canon = canonical.select("area_id", "canon")
    place = lambda df: df.join(canon, "area_id", "left").withColumn("canon", F.coalesce("canon", "area_id"))
    new = place(rows.where("name_en is not null")).groupBy("name_en", "canon").agg(F.min(seq).alias("_seq"), F.min_by("area_id", seq).alias("area_id"))
    have = place(buildings).select("name_en", "canon")
    new = new.alias("s").join(have.alias("i"), _null_safe(["name_en", "canon"]), "left_anti").select("s.*")
    return assign_ids(buildings, new, [F.col("_seq"), F.col("name_en")])


def backfill_building_project(buildings: DataFrame, rows: DataFrame, seq: str = "seq", mode: bool = False) -> DataFrame:
    """project_id of buildings that have none: the first later row's that knows it, or with mode the commonest."""
    known = rows.where("project_id is not null and building_id is not null")
    if mode:
        c = known.groupBy("building_id", "project_id").agg(F.count("*").alias("n"))
        found = c.groupBy("building_id").agg(F.max_by("project_id", F.struct("n", -F.col("project_id"))).alias("_p"))
    else:
        found = known.groupBy("building_id").agg(F.min_by("project_id", seq).alias("_p"))
    return buildings.join(found.withColumnRenamed("building_id", "id"), "id", "left").withColumn("project_id", F.coalesce("project_id", "_p")).drop("_p")


def upsert_area_codes(areas: DataFrame, lookup: DataFrame) -> DataFrame:
    """areas (id, name_en, code) with the register's codes, found by code first and then by name; the rest is added."""
    by_code = lookup.select(F.col("code").alias("_c1"), F.col("name_en").alias("_n1"))
    by_name = lookup.select(F.col("name_en").alias("_n2"), F.col("code").alias("_c2"))
    out = areas.join(by_code, F.col("code") == F.col("_c1"), "left").join(by_name, F.col("name_en") == F.col("_n2"), "left")
    out = out.select("id", F.coalesce("_n1", "name_en").alias("name_en"), F.coalesce("code", "_c2").alias("code"))
    new = lookup.join(out.select("code"), "code", "left_anti")
    return assign_ids(out, new.select("name_en", "code"), [F.col("code")])


def upsert_projects(projects: DataFrame, register: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Matched by number, else by name among projects that aren't masters; living attributes are overwritten, others added."""
    r = register.select(F.col("number").alias("_num"), F.col("name_en").alias("_name"), *[F.col(a).alias(f"_{a}") for a in attributes])
    by_number = projects.join(r, F.col("number") == F.col("_num"), "left")
    by_name = by_number.where("_num is null").select(*projects.columns).join(r, (F.col("name_en") == F.col("_name")) & ~F.col("is_master") & F.col("number").isNull(), "left")
    matched = by_number.where("_num is not null").unionByName(by_name)
    out = matched.select("id", "name_en", "is_master", F.coalesce("number", "_num").alias("number"), *[F.when(F.col("_num").isNotNull(), F.col(f"_{a}")).otherwise(F.col(a)).alias(a) for a in attributes])
    new = register.join(out.select("number"), "number", "left_anti").withColumn("is_master", F.lit(False))
    return assign_ids(out, new, [F.col("number")])


def upsert_building_register(buildings: DataFrame, register: DataFrame, canonical: DataFrame, update: Sequence[str]) -> DataFrame:
    """By name and area, the area redirected to the one stored for the same canonical place; guarded; locations untouched."""
    canon = canonical.select("area_id", "canon")
    place = lambda df: df.join(canon, "area_id", "left").withColumn("canon", F.coalesce("canon", "area_id"))
    stored = place(buildings).groupBy("name_en", "canon").agg(F.min("area_id").alias("_stored"))
    inc = place(register).join(stored, ["name_en", "canon"], "left").withColumn("area_id", F.coalesce("_stored", "area_id")).drop("_stored", "canon")
    inc = inc.groupBy("name_en", "area_id").agg(*[F.max(c).alias(c) for c in register.columns if c not in ("name_en", "area_id")])
    return guarded_upsert(buildings, inc, ("name_en", "area_id"), update)


def master_of_projects(projects: DataFrame) -> DataFrame:
    """Child projects with their masters' names."""
    m = projects.select(F.col("id").alias("master_project_id"), F.col("name_en").alias("master_name"))
    return projects.where("master_project_id is not null").join(m, "master_project_id", "left").select("id", "name_en", "master_project_id", "master_name")


def mark_processed(staged: DataFrame, batch: DataFrame, at: str) -> DataFrame:
    """staged with processed_at set for the ids of batch."""
    done = batch.select("id", F.lit(True).alias("_d"))
    return staged.join(done, "id", "left").withColumn("processed_at", F.when(F.col("_d") & F.col("processed_at").isNull(), F.lit(at).cast("timestamp")).otherwise(F.col("processed_at"))).drop("_d")
