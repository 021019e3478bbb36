"""Putting areas, buildings and projects on the map from landed geocoder candidates.

A point counts only when it lies in its area: inside the canonical area's
boundary, or near its centroid where there is no boundary.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AREA_ADDRESS_TYPES, CENTROID_RADIUS_M, PLACE_TYPES, PROJECT_ADDRESS_TYPES
from ..functions.clean import parent_names
from ..functions.geometry import bbox, haversine_m, point_geojson, point_in_multipolygon, shape_geojson
from ..sources.work import kept
from .areas import lookup

PRECISE_METHODS = ("building_point", "building_centroid", "validated")


def pick_candidate(candidates: DataFrame, types: Sequence[str], polygons_first: bool, key: str = "query") -> DataFrame:
    """The best candidate of each query: accepted type, polygon before point if wanted, importance, then name."""
    order = [F.col("shape").isNotNull().desc()] if polygons_first else []
    w = Window.partitionBy(key).orderBy(*order, F.desc("importance"), "name")
    return candidates.where(F.col("addresstype").isin(list(types))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pick_area_candidate(candidates: DataFrame) -> DataFrame:
    return pick_candidate(candidates, AREA_ADDRESS_TYPES, True)


def pick_project_candidate(candidates: DataFrame) -> DataFrame:
    return pick_candidate(candidates, PROJECT_ADDRESS_TYPES, False)


def pick_place_candidate(results: DataFrame, types: Sequence[str] = PLACE_TYPES) -> DataFrame:
    """The first result in given order (array ``results``) that has an accepted type and a coordinate."""
    ok = F.filter("results", lambda r: F.arrays_overlap(r["types"], F.array(*[F.lit(t) for t in types])) & r["lon"].isNotNull() & r["lat"].isNotNull())
    return results.withColumn("picked", F.get(ok, F.lit(0))).where("picked is not null").drop("results")


def match_area_names(areas: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each area's candidate: by its own name, else by the most specific parent name that has one."""
    tries = areas.select("id", F.col("name_en"), F.posexplode(F.concat(F.array("name_en"), parent_names(F.col("name_en")))).alias("step", "query"))
    picked = pick_area_candidate(candidates).withColumn("_hit", F.lit(True))
    w = Window.partitionBy("id").orderBy(F.col("_hit").isNull(), "step")
    best = tries.join(picked, "query", "left").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    method = F.when(F.col("_hit").isNull(), "unmatched").when(F.col("step") == 0, "exact").otherwise("parent_fallback")
    return best.withColumn("method", method).withColumn("query", F.when(F.col("_hit"), F.col("query"))).drop("_r", "_hit", "step")


def apply_area_match(areas: DataFrame, matches: DataFrame) -> DataFrame:
    """Centroid and boundary filled where missing; the method is stamped on any match."""
    m = matches.where("method <> 'unmatched'").select("id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("shape").alias("_shape"), F.col("method").alias("_method"))
    out = areas.join(m, "id", "left")
    had = F.col("lon").isNotNull()
    return out.select("id", "name_en", F.when(had, F.col("lon")).otherwise(F.col("_lon")).alias("lon"), F.when(had, F.col("lat")).otherwise(F.col("_lat")).alias("lat"), F.coalesce("boundary", "_shape").alias("boundary"), F.coalesce("_method", "geo_method").alias("geo_method"))


def areas_to_geocode(areas: DataFrame, evidence: DataFrame, either: bool = False) -> DataFrame:
    missing = F.col("lon").isNull() | (F.col("boundary").isNull() if either else F.lit(False))
    return areas.where(missing).join(evidence.where("reviewed").select(F.col("old_area_id").alias("id")).distinct(), "id", "left_anti")


def buildings_to_geocode(buildings: DataFrame, areas: DataFrame, sales: DataFrame, retry: bool = False) -> DataFrame:
    """Buildings with sales, in areas with a centroid, not placed yet (retry: not validated yet)."""
    todo = (F.coalesce("geo_method", F.lit("")) != "validated") if retry else F.col("geo_method").isNull()
    located = areas.where("lon is not null").select(F.col("id").alias("area_id"))
    sold = sales.where("building_id is not null").select(F.col("building_id").alias("id")).distinct()
    return buildings.where(todo).join(located, "area_id", "left_semi").join(sold, "id", "left_semi")


def validate_in_area(points: DataFrame, areas: DataFrame, area_column: str = "canonical_area_id", radius: float = CENTROID_RADIUS_M) -> DataFrame:
    """points (lon, lat) with ``inside``: in the area's boundary or near its centroid. A box test spares most ray casts."""
    a = areas.select(F.col("id").alias("_a"), F.col("lon").alias("_clon"), F.col("lat").alias("_clat"), F.col("boundary").alias("_b"), bbox(F.col("boundary")).alias("_box"))
    box = F.col("lon").between(F.col("_box.min_lon"), F.col("_box.max_lon")) & F.col("lat").between(F.col("_box.min_lat"), F.col("_box.max_lat"))
    held = F.when(box, point_in_multipolygon(F.col("_b"), F.col("lon"), F.col("lat"))).otherwise(F.lit(False))
    near = F.coalesce(haversine_m(F.col("lon"), F.col("lat"), F.col("_clon"), F.col("_clat")) <= radius, F.lit(False))
    out = points.join(a, F.col(area_column) == F.col("_a"), "left")
    return out.withColumn("inside", F.when(F.col("lon").isNull(), False).otherwise(F.coalesce(held, F.lit(False)) | near)).drop("_a", "_clon", "_clat", "_b", "_box")


def accept_points(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with location and method, counts by status): validated, outside or no_result."""
    status = F.when(F.col("lon").isNull(), "no_result").when(F.col("inside"), "validated").otherwise("outside")
    out = validated.withColumn("status", status)
    placed = out.select("id", F.when(F.col("status") == "validated", F.col("lon")).alias("lon"), F.when(F.col("status") == "validated", F.col("lat")).alias("lat"), F.col("status").alias("geo_method"))
    return placed, out.groupBy("status").agg(F.count("*").alias("n"))


#: Rounds of geometric_median() at most, and the gradient of a group's mean distance at which it has its median.
MEDIAN_ROUNDS, MEDIAN_GRADIENT = 200, 1e-10
_SAME = 1e-12  # degrees


def _pulls(points: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """For each group: sums over its points at the state's place (x, y) and at its candidate (cx, cy).

    gx, gy: pull of the points towards them; hxx, hxy, hyy: how the pull
    changes; w: sum of inverse distances; total: sum of distances; here: points
    at the place itself; near: the point next to it; ux, uy, there: pull and
    points at the candidate.
    """
    n, dx, dy, ex, ey = F.col("n"), F.col("lon") - F.col("x"), F.col("lat") - F.col("y"), F.col("lon") - F.col("cx"), F.col("lat") - F.col("cy")
    d, e = F.sqrt(dx * dx + dy * dy), F.sqrt(ex * ex + ey * ey)
    over = lambda c: F.nullif(F.col(c), F.lit(0.0))
    rows = points.join(lookup(state), key).select("*", dx.alias("dx"), dy.alias("dy"), d.alias("d"), ex.alias("ex"), ey.alias("ey"), e.alias("e"))
    far = lambda c, d: F.when(F.col(d) > _SAME, c)
    add = lambda c, d="d": F.coalesce(F.sum(far(c, d)), F.lit(0.0))
    return rows.groupBy(key).agg(
        add(n * F.col("dx") / over("d")).alias("gx"),
        add(n * F.col("dy") / over("d")).alias("gy"),
        add(n * F.col("dy") ** 2 / over("d") ** 3).alias("hxx"),
        add(-n * F.col("dx") * F.col("dy") / over("d") ** 3).alias("hxy"),
        add(n * F.col("dx") ** 2 / over("d") ** 3).alias("hyy"),
        add(n / over("d")).alias("w"),
        F.sum(n * F.col("d")).alias("total"),
        F.coalesce(F.sum(F.when(F.col("d") <= _SAME, n)), F.lit(0)).alias("here"),
        F.min_by(F.struct("lon", "lat"), F.struct("d", "lon", "lat")).alias("near"),
        add(n * F.col("ex") / over("e"), "e").alias("ux"),
        add(n * F.col("ey") / over("e"), "e").alias("uy"),
        F.coalesce(F.sum(F.when(F.col("e") <= _SAME, n)), F.lit(0)).alias("there"),
    )


def _stepped(state: DataFrame, pulls: DataFrame, key: str) -> DataFrame:
    """The state after a round: places that are medians are done, the others move."""
    s = state.join(lookup(pulls), key)
    c = F.col
    norm = lambda a, b: F.sqrt(c(a) ** 2 + c(b) ** 2)
    # a point is the median when the others pull at it with no more than its own weight
    corner = c("cx").isNotNull() & (norm("ux", "uy") <= c("there") * (1 + 1e-12))
    on_point = (c("here") > 0) & (norm("gx", "gy") <= c("here") * (1 + 1e-12))
    flat = (c("here") == 0) & (norm("gx", "gy") <= MEDIAN_GRADIENT * c("n_points"))
    done = corner | on_point | flat
    worse = c("total") > c("best") * (1 + 1e-15)  # the last step went too far: take the short one from where it began
    det = F.nullif(c("hxx") * c("hyy") - c("hxy") ** 2, F.lit(0.0))
    slack = F.when(c("here") > 0, 1 - c("here") / F.nullif(norm("gx", "gy"), F.lit(0.0))).otherwise(1.0)  # a point that is met holds the place back
    safe = {v: c(v) + slack * c(f"g{v}") / F.nullif(c("w"), F.lit(0.0)) for v in ("x", "y")}
    newton = {"x": c("x") + (c("hyy") * c("gx") - c("hxy") * c("gy")) / det, "y": c("y") + (c("hxx") * c("gy") - c("hxy") * c("gx")) / det}
    bold = (c("here") == 0) & F.coalesce(det > 1e-9 * c("hxx") * c("hyy"), F.lit(False))
    move = lambda v: F.when(corner, c(f"c{v}")).when(done, c(v)).when(worse, c(f"s{v}")).when(bold, newton[v]).otherwise(safe[v])
    return s.select(
        key, "n_points", move("x").alias("x"), move("y").alias("y"),
        *[F.when(worse & ~done, c(f"s{v}")).otherwise(safe[v]).alias(f"s{v}") for v in ("x", "y")],
        F.least("best", "total").alias("best"), c("near.lon").alias("cx"), c("near.lat").alias("cy"), done.alias("done"),
    )


def geometric_median(points: DataFrame, key: str) -> DataFrame:
    """(key, lon, lat, n_points, spread_p90_m): planar median of each group's points and the 90th percentile of distances to it.

    The point of least total distance is found for all groups at once, in
    rounds. A round is one aggregation, combined before it is shuffled, so a
    group may have any number of points: it gives each group's pull, a Newton
    step from that (the short step of Weiszfeld where the Newton step went too
    far or can't be told), and tests the point next to the place exactly. Groups
    that are done leave the next round; each round's state, a row a group, is
    written, so nothing is done twice. Points on one line may have many medians:
    one of them is taken. Null keys are a group, points without a place don't count.
    """
    known = points.where("lon is not null and lat is not null").select(F.struct(F.col(key)).alias("_g"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    p = kept(known.groupBy("_g", "lon", "lat").agg(F.count("*").alias("n")), "points")
    none = F.lit(None).cast("double")
    n = F.col("n")
    start = p.groupBy("_g").agg(F.sum("n").alias("n_points"), (F.sum(F.col("lon") * n) / F.sum("n")).alias("x"), (F.sum(F.col("lat") * n) / F.sum("n")).alias("y"))
    state = kept(start.select("*", none.alias("sx"), none.alias("sy"), F.lit(float("inf")).alias("best"), none.alias("cx"), none.alias("cy"), F.lit(False).alias("done")), "median")
    ready = []
    for _ in range(MEDIAN_ROUNDS):
        state = kept(_stepped(state, _pulls(p, state, "_g"), "_g"), "median")
        ready.append(state.where("done"))
        state = state.where("not done")
        if state.isEmpty():
            break
    med = reduce(DataFrame.unionByName, [*ready, state]).select("_g", F.col("x").alias("_mlon"), F.col("y").alias("_mlat"), "n_points")
    far = p.join(lookup(med), "_g")
    spread = far.groupBy("_g", "_mlon", "_mlat", "n_points").agg(F.percentile(haversine_m(F.col("lon"), F.col("lat"), F.col("_mlon"), F.col("_mlat")), F.lit(0.9), F.col("n")).alias("spread_p90_m"))
    return spread.select(F.col(f"_g.{key}").alias(key), F.col("_mlon").alias("lon"), F.col("_mlat").alias("lat"), "n_points", "spread_p90_m")


def place_projects(projects: DataFrame, buildings: DataFrame, areas: DataFrame) -> DataFrame:
    """Projects that aren't masters, at the median of their validated buildings if that lies in their area."""
    placed = buildings.where("geo_method = 'validated' and project_id is not null")
    med = geometric_median(placed, "project_id")
    p = projects.where("not is_master").select(F.col("id").alias("project_id"), F.col("area_id").alias("canonical_area_id"))
    v = validate_in_area(med.join(p, "project_id"), areas)
    method = F.when(F.col("n_points") == 1, "building_point").otherwise("building_centroid")
    return v.where("inside").select("project_id", "lon", "lat", "n_points", F.round("spread_p90_m", 1).alias("spread_p90_m"), method.alias("geo_method"))


def place_master_projects(projects: DataFrame, placed: DataFrame) -> DataFrame:
    """Masters at the median of their precisely placed children."""
    kids = projects.where("master_project_id is not null").select(F.col("id").alias("project_id"), "master_project_id")
    return geometric_median(placed.where(F.col("geo_method").isin("building_point", "building_centroid")).join(kids, "project_id"), "master_project_id").withColumn("geo_method", F.lit("children_centroid"))


def accept_project_points(projects: DataFrame, found: DataFrame) -> DataFrame:
    """External points that validated, for projects without a better one; building-derived points rank higher and stay."""
    f = found.where("inside").select("id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    out = projects.join(f, "id", "left")
    take = F.col("_lon").isNotNull() & ~F.coalesce(F.col("geo_method").isin(*PRECISE_METHODS), F.lit(False))
    return out.withColumn("lon", F.when(take, F.col("_lon")).otherwise(F.col("lon"))).withColumn("lat", F.when(take, F.col("_lat")).otherwise(F.col("lat"))).withColumn("geo_method", F.when(take, "validated").otherwise(F.col("geo_method"))).drop("_lon", "_lat")


def backfill_area_centroid(projects: DataFrame, areas: DataFrame) -> DataFrame:
    """Projects without a point at their area's centroid."""
    a = areas.where("lon is not null").select(F.col("id").alias("area_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    out = projects.join(a, "area_id", "left")
    fill = F.col("lon").isNull() & F.col("_lon").isNotNull()
    return out.withColumn("geo_method", F.when(fill, "area_centroid").otherwise(F.col("geo_method"))).withColumn("lat", F.coalesce("lat", "_lat")).withColumn("lon", F.coalesce("lon", "_lon")).drop("_lon", "_lat")


def latest_area_metrics(mart: DataFrame, as_of: str, min_sample: int) -> DataFrame:
    """Each area's last month with enough sales; of several usages the one with most. 0 is a value."""
    w = Window.partitionBy("area_id").orderBy(F.desc("month"), F.desc("sale_cnt"), "usage")
    ok = (F.col("month") <= F.lit(as_of).cast("date")) & (F.col("sale_cnt") >= min_sample)
    return mart.where(ok).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _geometry(boundary: Column | None = None) -> Column:
    point = point_geojson(F.col("lon"), F.col("lat"))
    return point if boundary is None else F.coalesce(shape_geojson(boundary), point)


def areas_feature_collection(areas: DataFrame, metrics: DataFrame, evidence: DataFrame) -> DataFrame:
    """Current areas with a geometry (boundary, else centroid) and their latest metrics."""
    current = areas.join(evidence.where("reviewed").select(F.col("old_area_id").alias("id")).distinct(), "id", "left_anti")
    out = current.withColumn("geometry", _geometry(F.col("boundary"))).where("geometry is not null")
    m = metrics.select(F.col("area_id").alias("id"), "month", "usage", "sale_median_price_m2", "rent_median_annual_m2", "gross_yield_pct")
    return out.join(m, "id", "left").select("id", "name_en", "geometry", "month", "usage", "sale_median_price_m2", "rent_median_annual_m2", "gross_yield_pct")


def projects_feature_collection(projects: DataFrame) -> DataFrame:
    precise = F.col("geo_method").isNotNull() & (F.col("geo_method") != "area_centroid")
    return projects.where("lon is not null").select("id", "name_en", _geometry().alias("geometry"), "geo_method", precise.alias("is_precise"))


def buildings_feature_collection(buildings: DataFrame) -> DataFrame:
    return buildings.where("lon is not null").select("id", "name_en", "area_id", "project_id", _geometry().alias("geometry"))
