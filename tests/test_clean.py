from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from freehold.functions import clean as C
from freehold.functions.geometry import geojson_to_multipolygon, point_in_multipolygon, to_wkt
from freehold.functions.text import trigram_similarity


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (C.norm_name, "  al   barsha ", "AL BARSHA"), (C.norm_name, "  ", None), (C.norm_name, None, None), (C.to_text, "  x ", "x"), (C.to_text, " ", None),
        (C.to_float, "1.5", 1.5), (C.to_float, "nan", None), (C.to_float, "inf", None), (C.to_float, "x", None), (C.to_int, "1.9", 1), (C.to_int, "-1.9", -1), (C.to_int, "", None),
        (C.to_bool, "", None), (C.to_bool, "1", True), (C.to_bool, "true", True), (C.to_bool, "no", False), (C.txn_key_bulk, "1-102-2026-59715", "102-2026-59715"), (C.txn_key_bulk, "102-2026-5", None),
        (C.txn_key_bulk, "1--2026-5", None), (C.txn_key_gateway, "102-59715-2026", "102-2026-59715"), (C.txn_key_gateway, "a-b", None), (C.parent_names, "AL QUSAIS SOUTH THIRD", ["AL QUSAIS SOUTH", "AL QUSAIS"]), (C.parent_names, "DEIRA", []),
    ],
)
def test_scalar(spark, f, given, expected):
    assert value(spark, f(F.lit(given).cast("string"))) == expected


def test_dates(spark):
    assert str(value(spark, C.to_iso_date(F.lit("2026-07-07T10:00:00")))) == "2026-07-07"
    assert value(spark, C.to_iso_date(F.lit("07-07-2026"))) is None
    assert value(spark, C.to_iso_date(F.lit("2026-02-30"))) is None


def test_money(spark):
    assert value(spark, C.per_m2(F.lit("2000000.00").cast("decimal(14,2)"), F.lit("100.19").cast("decimal(12,2)"))) == Decimal("19962.07")
    assert value(spark, C.per_m2(F.lit(1), F.lit(0))) is None
    assert value(spark, C.per_property(F.lit(72000.0), F.lit(3))) == 24000
    assert value(spark, C.per_property(F.lit(72000.0), F.lit(0))) == 72000


def test_growth(spark):
    assert value(spark, C.cagr_pct(F.lit(10000.0), F.lit(18000.0), F.lit(8.0))) == pytest.approx(7.6, abs=0.05)
    assert value(spark, C.cagr_pct(F.lit(1.0), F.lit(2.0), F.lit(1.0))) == pytest.approx(100)
    assert value(spark, C.cagr_pct(F.lit(0.0), F.lit(2.0), F.lit(1.0))) is None
    assert value(spark, C.pct_change(F.lit(1.0), F.lit(0.0))) is None


def test_record_hash_ignores_order_and_volatile_fields(spark):
    h = lambda p, e="sales": value(spark, C.record_hash(F.lit(e), F.lit(p)))
    assert h('{"A":"1","B":"é","RN":"5"}') == h('{"B":"é","TOTAL":"9","A":"1"}')
    assert h('{"A":"1"}') != h('{"A":"2"}') and h('{"A":"1"}') != h('{"A":"1"}', "rents")


@pytest.mark.parametrize(("a", "b", "s"), [("Marina", "PORTO MARINA", 7 / 13), ("jumera village", "JUMEIRAH VILLAGE CIRCLE", 12 / 27), ("MARINA GATE", "marina", 7 / 12), ("", "", 0.0)])
def test_trigrams(spark, a, b, s):
    assert value(spark, trigram_similarity(F.lit(a), F.lit(b))) == pytest.approx(s)


def test_shapes(spark):
    hole = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}'
    shape = geojson_to_multipolygon(F.lit(hole))
    inside = lambda x, y: value(spark, point_in_multipolygon(shape, F.lit(float(x)), F.lit(float(y))))
    assert [inside(3, 3), inside(1.5, 1.5), inside(5, 1), inside(0.5, 3.5)] == [True, False, False, True]
    assert value(spark, geojson_to_multipolygon(F.lit('{"type":"Point","coordinates":[1,2]}'))) is None
    assert value(spark, to_wkt(shape)).startswith("MULTIPOLYGON(((0.0 0.0, 4.0 0.0")


def test_geometric_median(spark):
    from freehold.operators.places import geometric_median

    groups = {1: [(1.0, 2.0)], 2: [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (2.0, 2.0), (1.0, 1.0)], 3: [(0.0, 0.0)] * 3 + [(9.0, 9.0)], None: [(3.0, 3.0), (5.0, 3.0)]}
    points = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps] + [(4, None, 1.0)], "g int, lon double, lat double")
    got = {x["g"]: (x["lon"], x["lat"], x["n_points"]) for x in geometric_median(points, "g").collect()}
    assert got == {1: (1.0, 2.0, 1), 2: (1.0, 1.0, 5), 3: (0.0, 0.0, 4), None: (4.0, 3.0, 2)}


def test_a_group_of_any_size_is_summed_in_parts(spark, monkeypatch):
    """One group of most points, joined by a shuffle as well as by broadcast: the median that short steps find, and no Python in its tasks."""
    import numpy as np

    from freehold.operators import areas
    from freehold.operators.places import _pulls, geometric_median

    rng = np.random.default_rng(3)
    p = rng.normal(size=(4000, 2)) * (1, 0.1) + (55, 25)
    points = spark.createDataFrame([(int(k % 50 == 0), float(x), float(y)) for k, (x, y) in enumerate(p)], "g int, lon double, lat double")
    for most in (200_000, 0):
        monkeypatch.setattr(areas, "LOOKUP_ROWS", most)
        for x in geometric_median(points, "g").collect():
            mine = p[(np.arange(4000) % 50 == 0) == bool(x["g"])]
            at = mine.mean(axis=0)
            for _ in range(3000):
                w = 1 / np.sqrt(((mine - at) ** 2).sum(axis=1))
                at = (mine * w[:, None]).sum(axis=0) / w.sum()
            assert (x["lon"], x["lat"]) == pytest.approx(tuple(at), abs=1e-8)
    state = points.selectExpr("g", "lon as x", "lat as y", "lon as cx", "lat as cy").limit(1)
    plan = _pulls(points.withColumn("n", points["g"] * 0 + 1), state, "g")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan
