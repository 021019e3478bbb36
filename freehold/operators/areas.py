"""Area codes that were split or renamed: detecting splits, reviewing them, and redirecting at read time.

Facts keep the area they were reported with. A reader asks for the canonical
area, project first; only reviewed evidence redirects, and an old area with
several successors is never guessed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SPLIT_MIN_OVERLAP_PCT, SPLIT_WINDOW_DAYS


#: Rows of a lookup table that may be broadcast, after they were counted.
LOOKUP_ROWS = 200_000


def lookup(df: DataFrame) -> DataFrame:
    """A small dimension for a join with facts: broadcast if it has at most LOOKUP_ROWS rows, so that facts aren't shuffled for it."""
    return F.broadcast(df) if df.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else df


def single_successor(evidence: DataFrame) -> DataFrame:
    """old_area_id -> its one reviewed successor."""
    g = evidence.where("reviewed").groupBy("old_area_id").agg(F.max("new_area_id").alias("new_area_id"), F.count("*").alias("n"))
    return g.where("n = 1").drop("n")


def ambiguous_areas(evidence: DataFrame) -> DataFrame:
    return evidence.where("reviewed").groupBy("old_area_id").agg(F.count("*").alias("successors")).where("successors > 1")


def project_actual_reviewed(project_actual: DataFrame, evidence: DataFrame) -> DataFrame:
    """project_id -> new area, where the pair is reviewed."""
    return project_actual.join(evidence.where("reviewed").select("old_area_id", "new_area_id"), ["old_area_id", "new_area_id"]).select("project_id", "new_area_id")


def with_canonical_area(facts: DataFrame, projects: DataFrame, evidence: DataFrame, project_actual: DataFrame) -> DataFrame:
    """facts with canonical_area_id: reviewed project target, the project's own area, the sole successor, the area as reported.

    The three lookups have one row a project or an area at most.
    """
    pick = lambda df, key, value, to: df.select(F.col(key).alias(f"_{to}_k"), F.col(value).alias(f"_{to}"))
    out = facts
    for df, key, value, to, on in (
        (project_actual_reviewed(project_actual, evidence), "project_id", "new_area_id", "target", "project_id"),
        (projects, "id", "area_id", "own", "project_id"),
        (single_successor(evidence), "old_area_id", "new_area_id", "succ", "area_id"),
    ):
        out = out.join(lookup(pick(df, key, value, to)), F.col(on) == F.col(f"_{to}_k"), "left").drop(f"_{to}_k")
    return out.withColumn("canonical_area_id", F.coalesce("_target", "_own", "_succ", "area_id")).drop("_target", "_own", "_succ")


def candidate_new_areas(sales: DataFrame, as_of: str, days: int = SPLIT_WINDOW_DAYS) -> DataFrame:
    """Areas whose first sale ever is at most ``days`` before as_of."""
    return sales.where("area_id is not null").groupBy("area_id").agg(F.min(F.col("txn_date").cast("date")).alias("first_sale")).where(F.col("first_sale") >= F.date_sub(F.lit(as_of).cast("date"), days))


def dominant_old_area(sales: DataFrame, candidates: DataFrame, min_overlap: float = SPLIT_MIN_OVERLAP_PCT) -> DataFrame:
    """For each candidate the other area with most sales on the candidate's projects, where enough of them are shared.

    All candidates at once; sales are first reduced to counts by (project, area), so a busy project is one row an area.
    """
    counts = sales.where("project_id is not null and area_id is not null").groupBy("project_id", "area_id").agg(F.count("*").alias("n"))
    mine = counts.join(candidates.select("area_id"), "area_id", "left_semi").select("project_id", F.col("area_id").alias("new_area_id"))
    total = mine.groupBy("new_area_id").agg(F.count("*").alias("projects"))
    met = mine.join(counts, "project_id").where("area_id <> new_area_id").groupBy("new_area_id", F.col("area_id").alias("old_area_id")).agg(F.sum("n").alias("txn_count"), F.count("*").alias("shared_projects"), F.array_sort(F.collect_list("project_id")).alias("project_ids"))
    first = Window.partitionBy("new_area_id").orderBy(F.desc("txn_count"), "old_area_id")
    best = met.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r").join(total, "new_area_id")
    return best.withColumn("overlap_pct", F.round(F.col("shared_projects") * 100.0 / F.col("projects"), 2)).where(F.col("overlap_pct") >= min_overlap)


def detect_area_splits(sales: DataFrame, as_of: str, days: int = SPLIT_WINDOW_DAYS, min_overlap: float = SPLIT_MIN_OVERLAP_PCT) -> DataFrame:
    """Evidence rows: new and old area, counts and overlap."""
    found = candidate_new_areas(sales, as_of, days)
    own = sales.groupBy("area_id").agg(F.count("*").alias("new_txn_count"))
    return dominant_old_area(sales, found, min_overlap).join(found, F.col("new_area_id") == F.col("area_id")).drop("area_id").join(own, F.col("new_area_id") == F.col("area_id")).drop("area_id")


def split_projects(splits: DataFrame) -> DataFrame:
    return splits.select(F.explode("project_ids").alias("project_id"), "old_area_id", "new_area_id")


def upsert_evidence(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Counts refreshed from found; ``reviewed`` is only ever the stored one, false for new pairs."""
    s, f = stored.alias("s"), found.alias("f")
    key = [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("old_area_id", "new_area_id")]
    values = [c for c in found.columns if c not in ("old_area_id", "new_area_id", "reviewed")]
    old = lambda c: F.col(f"s.{c}") if c in stored.columns else F.lit(None)
    return s.join(f, key[0] & key[1], "full").select(*[F.coalesce(f"s.{k}", f"f.{k}").alias(k) for k in ("old_area_id", "new_area_id")], *[F.coalesce(F.col(f"f.{c}"), old(c)).alias(c) for c in values], F.coalesce("s.reviewed", F.lit(False)).alias("reviewed"))


def upsert_project_actual(stored: DataFrame, found: DataFrame) -> DataFrame:
    """One row a project; the last detection wins."""
    s, f = stored.alias("s"), found.alias("f")
    return s.join(f, F.col("s.project_id") == F.col("f.project_id"), "full").select(F.coalesce("f.project_id", "s.project_id").alias("project_id"), F.coalesce("f.old_area_id", "s.old_area_id").alias("old_area_id"), F.coalesce("f.new_area_id", "s.new_area_id").alias("new_area_id"))


def review_split(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """(old, new, approve) applied: evidence with reviewed as decided, and outcome set / already / unchanged."""
    d = decisions.select("old_area_id", "new_area_id", "approve")
    out = evidence.join(d, ["old_area_id", "new_area_id"], "left")
    outcome = F.when(F.col("approve").isNull(), "unchanged").when(F.col("approve") == F.col("reviewed"), "already").otherwise("set")
    return out.withColumn("outcome", outcome).withColumn("reviewed", F.coalesce("approve", "reviewed")).drop("approve")


def area_lineage(areas: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per area: all reviewed successors, and the old areas of which it is the sole successor, as sorted ids."""
    succ = evidence.where("reviewed").groupBy(F.col("old_area_id").alias("id")).agg(F.array_sort(F.collect_set("new_area_id")).alias("successors"))
    pred = single_successor(evidence).groupBy(F.col("new_area_id").alias("id")).agg(F.array_sort(F.collect_set("old_area_id")).alias("predecessors"))
    none = F.array().cast("array<int>")
    return areas.join(succ, "id", "left").join(pred, "id", "left").withColumn("successors", F.coalesce("successors", none)).withColumn("predecessors", F.coalesce("predecessors", none))


def expand_area_ids(requested: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids to read, errors): canonical ids of the requested and their sole predecessors; ambiguous ids with their candidates."""
    one, many = single_successor(evidence), ambiguous_areas(evidence)
    asked = requested.select("area_id").distinct()
    errors = asked.join(many, F.col("area_id") == F.col("old_area_id"), "left_semi").join(evidence.where("reviewed"), F.col("area_id") == F.col("old_area_id")).groupBy("area_id").agg(F.array_sort(F.collect_set("new_area_id")).alias("candidates"))
    clear = asked.join(many, F.col("area_id") == F.col("old_area_id"), "left_anti")
    canon = clear.join(one, F.col("area_id") == F.col("old_area_id"), "left").select(F.coalesce("new_area_id", "area_id").alias("area_id")).distinct()
    older = canon.join(one, F.col("area_id") == F.col("new_area_id")).select(F.col("old_area_id").alias("area_id"))
    return canon.unionByName(older).distinct(), errors


def in_area_scope(facts: DataFrame, expanded: DataFrame, canonical: DataFrame, project_reviewed: DataFrame) -> DataFrame:
    """Facts whose own area is among expanded, or whose project is redirected into canonical."""
    hit = project_reviewed.join(canonical.select(F.col("area_id").alias("new_area_id")), "new_area_id", "left_semi").select(F.col("project_id").alias("_p")).distinct()
    areas = expanded.select(F.col("area_id").alias("_a")).distinct()
    out = facts.join(areas, F.col("area_id") == F.col("_a"), "left").join(hit, F.col("project_id") == F.col("_p"), "left")
    return out.where("_a is not null or _p is not null").drop("_a", "_p")


def exclude_superseded(rows: DataFrame, evidence: DataFrame, column: str = "area_id") -> DataFrame:
    return rows.join(evidence.where("reviewed").select(F.col("old_area_id").alias(column)).distinct(), column, "left_anti")


def exclude_ambiguous_old(rows: DataFrame, evidence: DataFrame, column: str = "area_id") -> DataFrame:
    return rows.join(ambiguous_areas(evidence).select(F.col("old_area_id").alias(column)), column, "left_anti")


def canonical_label(rows: DataFrame, areas: DataFrame, evidence: DataFrame, column: str = "area_id") -> DataFrame:
    """rows with canonical_area_id and its name."""
    one = single_successor(evidence).select(F.col("old_area_id").alias("_old"), F.col("new_area_id").alias("_new"))
    out = rows.join(one, F.col(column) == F.col("_old"), "left").withColumn("canonical_area_id", F.coalesce("_new", column)).drop("_old", "_new")
    return out.join(areas.select(F.col("id").alias("canonical_area_id"), F.col("name_en").alias("area_name")), "canonical_area_id", "left")

