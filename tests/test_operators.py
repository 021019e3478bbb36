import datetime as dt

import pytest
from pyspark.sql import functions as F

from freehold.operators import areas as A
from freehold.operators import fuzzy as I
from freehold.operators import listings as H
from freehold.operators import precedence as P
from freehold.operators import series as S
from freehold.operators import upsert as U
from freehold.sources import landing as L
from freehold.streaming import feed as T


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


EVIDENCE = [(20, 292, True), (600, 701, True), (600, 702, True), (9, 23, False)]


@pytest.fixture
def evidence(spark):
    return spark.createDataFrame(EVIDENCE, "old_area_id int, new_area_id int, reviewed boolean")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "area_id int")


def test_expand(spark, evidence):
    for asked, expected in (((20,), [20, 292]), ((292,), [20, 292]), ((500,), [500]), ((9,), [9])):
        ok, bad = A.expand_area_ids(ids(spark, *asked), evidence)
        assert [r[0] for r in rows(ok, "area_id")] == expected and bad.count() == 0
    ok, bad = A.expand_area_ids(ids(spark, 600), evidence)
    assert ok.count() == 0 and bad.first()["candidates"] == [701, 702]


def test_canonical_area_is_project_first(spark, evidence):
    facts = spark.createDataFrame([(1, 600, 9001), (2, 600, 9002), (3, 600, None), (4, 20, None), (5, 20, 8), (6, 9, None)], "k int, area_id int, project_id int")
    projects = spark.createDataFrame([(9001, 600), (9002, 600), (8, 20)], "id int, area_id int")
    actual = spark.createDataFrame([(9001, 600, 701), (9002, 600, 702)], "project_id int, old_area_id int, new_area_id int")
    assert rows(A.with_canonical_area(facts, projects, evidence, actual), "k", "canonical_area_id") == [(1, 701), (2, 702), (3, 600), (4, 292), (5, 20), (6, 9)]


def test_review_keeps_and_reports(spark, evidence):
    d = spark.createDataFrame([(9, 23, True), (20, 292, True)], "old_area_id int, new_area_id int, approve boolean")
    assert (9, 23, True, "set") in rows(A.review_split(evidence, d), "old_area_id", "new_area_id", "reviewed", "outcome")
    found = spark.createDataFrame([(9, 23, 5), (1, 2, 7)], "old_area_id int, new_area_id int, txn_count int")
    assert rows(A.upsert_evidence(evidence, found), "old_area_id", "new_area_id", "reviewed") == [(1, 2, False), (9, 23, False), (20, 292, True), (600, 701, True), (600, 702, True)]


def test_precedence(spark):
    facts = spark.createDataFrame([(1, 1, None), (2, 2, "2020-01-01"), (3, 2, "2020-01-02"), (4, 2, None)], "k int, source_id int, d string").withColumn("d", F.to_date("d"))
    cut = spark.createDataFrame([("2020-01-01",)], "c string").select(F.to_date("c").alias("cutover_date"))
    assert [r[0] for r in rows(P.apply_precedence(facts, "d", cut), "k")] == [1, 3]
    assert P.apply_precedence(facts, "d", cut.limit(0)).count() == 4


def months(spark, prices, rents=None, start=dt.date(2015, 1, 1), n=10):
    out = []
    for i, p in enumerate(prices):
        y, m = divmod(start.month - 1 + i, 12)
        out.append((1, dt.date(start.year + y, m + 1, 1), "Residential", float(p), n, float(rents[i]) if rents else None, n if rents else 0))
    return spark.createDataFrame(out, "entity_id int, month date, usage string, sale_median_price_m2 double, sale_cnt bigint, rent_median_annual_m2 double, rent_cnt bigint")


def test_short_series_has_no_growth_but_a_level(spark):
    g = S.capital_growth(months(spark, [100, 101, 102])).first()
    assert g["capital_growth_cagr_pct"] is None and g["years"] == 0.0 and g["start_value_aed_m2"] == 101


def test_span_guard(spark):
    p = [12000 * (1 + 0.004 * i) for i in range(26)]
    assert S.capital_growth(months(spark, p[:24], start=dt.date(2021, 1, 1))).first()["capital_growth_cagr_pct"] is None
    g = S.capital_growth(months(spark, p)).first()
    assert g["capital_growth_cagr_pct"] is not None and g["years"] == pytest.approx(1.16, abs=0.1)


def test_yield_reads_the_last_year(spark):
    p = months(spark, [500] * 12 + [1000] * 12, [10] * 12 + [80] * 12)
    assert S.gross_rental_yield(p).first()["gross_rental_yield_pct"] == 8.0


@pytest.mark.parametrize(("levels", "run"), [((100, 110, 121, 133), 3), ((100, 90, 95, 99), 2), ((100, 110, 105), 0)])
def test_runs_of_rises(spark, levels, run):
    p = months(spark, [x for v in levels for x in [v] * 12])
    assert S.consecutive_yoy_increases(S.yoy_steps(p)).first()["yoy_run"] == run


def test_mask_and_gaps(spark):
    p = months(spark, [100, 110, 120], n=2)
    m = S.mask_min_sample(p, 3)
    assert m.where("sale_median_price_m2 is null and sale_cnt = 0").count() == 3
    gap = p.where("sale_median_price_m2 <> 110")
    f = S.month_changes(S.fill_month_gaps(gap), "sale_median_price_m2")
    assert f.count() == 3 and f.where("mom_pct is not null").count() == 0


def test_scales(spark):
    d = spark.createDataFrame([(None,), (0.0,), (1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert rows(S.quantile_classes(d, "v").where("v is not null"), "v", "quantile_class") == [(0.0, 0), (1.0, 1), (2.0, 2), (3.0, 3), (4.0, 4)]
    assert S.minmax_scale(d.where("v = 1"), "v", 2, 9).first()["scaled"] == 2


def test_ranking_arguments(spark):
    with pytest.raises(ValueError):
        S.ranking(months(spark, [1]), spark.createDataFrame([(1, "a")], "id int, name_en string"), "nonsense")
    with pytest.raises(ValueError):
        S.building_ranking(None, None, "gross_yield")


def test_natural_key_and_guarded_upsert(spark):
    s = "k int, n int, a int, b int"
    raw = spark.createDataFrame([(1, None, 1, 1), (1, None, 2, 2), (2, 5, 9, 9)], s)
    last = U.dedupe_natural_key(raw, ("k", "n"), [F.col("a")])
    assert last.count() == 2
    stored = spark.createDataFrame([(1, None, 2, 7), (3, 1, 1, 1)], s)
    out = U.guarded_upsert(stored, last, ("k", "n"), ("a",))
    assert sorted((r["k"], r["a"], r["b"], r["action"]) for r in out.collect()) == [(1, 2, 7, "keep"), (2, 9, 9, "insert"), (3, 1, 1, "keep")]
    again = U.guarded_upsert(out.drop("action"), last, ("k", "n"), ("a",))
    assert again.where("action <> 'keep'").count() == 0


def test_building_keeps_the_reported_area(spark):
    rows_in = spark.createDataFrame([("T", 3, 2), ("T", 20, 1), ("U", 5, 3)], "name_en string, area_id int, seq int")
    canon = spark.createDataFrame([(3, 20)], "area_id int, canon int")
    out = U.dim_building_get_or_create(spark.createDataFrame([], "id bigint, name_en string, area_id int"), rows_in, canon)
    assert rows(out, "id", "name_en", "area_id") == [(1, "T", 20), (2, "U", 5)]


def test_bulk_rows(spark):
    base = dict.fromkeys(L.SALE_COLUMNS)
    good = base | {"transaction_id": "1-102-2026-59715", "instance_date": "2026-07-07", "actual_worth": "2000000.00", "trans_group_en": "Sales", "reg_type_en": "Existing Properties", "area_name_en": "Al  Jadaf", "procedure_area": "100.19"}
    df = spark.createDataFrame([good, good | {"instance_date": "07-07-2026"}, good | {"actual_worth": None}], L.strings(L.SALE_COLUMNS))
    r = L.map_bulk_sale(df).collect()
    assert [x["valid"] for x in r] == [True, False, False]
    assert (r[0]["txn_key"], r[0]["is_offplan"], r[0]["is_freehold"], str(r[0]["price_per_m2"]), r[0]["area_name"]) == ("102-2026-59715", False, None, "19962.07", "AL JADAF")


def test_bulk_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "sales_2026-07-01_1.csv").write_text("﻿transaction_id,instance_date\n1-2-3-4,2026-01-01\n", encoding="utf-8")
    (tmp_path / "sales_summary_1.csv").write_text("transaction_id,instance_date\nx,y\n")
    out = L.scan_bulk_csv(spark, f"file://{tmp_path}", "sales", ("transaction_id", "instance_date"))
    assert rows(out, "transaction_id", "instance_date") == [("1-2-3-4", "2026-01-01")]
    assert str(P.export_date(out).first()["cutover_date"]) == "2026-07-01"


def test_gateway_pages(spark):
    pages = spark.createDataFrame([('{"responseCode":200,"response":{"result":[{"AREA_ID":"5","NAME_EN":"x  y"},{"AREA_ID":"6"}]}}',), ('{"responseCode":500,"response":{"result":[{"AREA_ID":"7"}]}}',), ("junk",)], "value string")
    assert rows(L.map_area_lookup(L.scan_gateway_json(pages)), "code", "name_en") == [(5, "X Y"), (6, None)] or L.scan_gateway_json(pages).count() == 2


def test_rent_reference(spark):
    p = '{"REGISTRATION_DATE":"2024-06-01T00:00:00","AREA_EN":"Old Harbour","ANNUAL_AMOUNT":"120000","ACTUAL_AREA":"80","START_DATE":"2024-06-01","END_DATE":"2025-05-31"}'
    r = L.map_gateway_rent(spark.createDataFrame([(p,)], "payload string")).first()
    assert r["source_ref"] == "2024-06-01|Old Harbour|120000|80|2024-06-01|2025-05-31" and r["valid"]


def test_month_windows(spark):
    r = spark.createDataFrame([("a", "2023-12-15", "2024-02-03"), ("b", "2024-02-02", "2024-02-01")], "endpoint string, f string, t string").select("endpoint", F.to_date("f").alias("date_from"), F.to_date("t").alias("date_to"))
    assert [(str(a), str(b)) for a, b in rows(T.month_windows(r), "date_from", "date_to")] == [("2023-12-15", "2023-12-31"), ("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-03")]


def test_resolve(spark):
    names = spark.createDataFrame([(1, "PORTO MARINA"), (2, "MARINA GATE 1"), (3, "MARINA GATE 2"), (4, "DEIRA")], "id int, name string")
    q = spark.createDataFrame([("porto marina",), ("marina gate",), ("jvc",)], "query string")
    assert rows(I.resolve_entity(q, names), "query", "status") == [("jvc", "no match"), ("marina gate", "ambiguous"), ("porto marina", "resolved")]


def test_listing_arguments(spark):
    with pytest.raises(ValueError):
        H.list_transactions(None, None, usage="x")
    with pytest.raises(ValueError):
        H.page_with_has_more(None, [], 0)
    p = H.page_with_has_more(spark.range(5), [F.col("id")], 2, 3)
    assert [tuple(r) for r in p.collect()] == [(3, False), (4, False)]


def test_replayed_batch_stages_nothing_twice(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "record_hash string, v int")
    contents = T.StagedContents(spark, f"file://{tmp_path}/staged", batch.schema)
    sink = T.staging_sink(contents)
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.union(spark.createDataFrame([("c", 3)], batch.schema)), 1)
    assert [r[0] for r in rows(contents.read(), "record_hash")] == ["a", "b", "c"]


def test_staging_equals_a_set_and_reads_candidates_only(spark, tmp_path):
    """Random batches against a set; a batch of new contents reads no bucket file, one of old contents only theirs."""
    import random

    r = random.Random(6)
    schema = T.schema_of("record_hash string, v int")
    contents = T.StagedContents(spark, f"file://{tmp_path}/staged", schema, buckets=4, bits=1 << 15, merge_after=3)
    seen: set[str] = set()
    for batch in range(9):
        hashes = [f"h{r.randrange(60)}" for _ in range(15)]
        added = contents.stage(spark.createDataFrame([(h, batch) for h in hashes], schema), batch)
        assert added == len(set(hashes) - seen)
        seen |= set(hashes)
        assert sorted(x[0] for x in contents.read().select("record_hash").collect()) == sorted(seen)
        assert len(contents.versions.current()[1]["folders"]) <= 4
    contents.stage(spark.createDataFrame([(f"new{k}", 0) for k in range(50)], schema), 9)
    assert contents.last_read == []
    assert contents.stage(spark.createDataFrame([("new7", 0)], schema), 10) == 0 and len(contents.last_read) == 1
    assert contents.stage(spark.createDataFrame([("other", 0)], schema), 10) == 0  # done before
    contents.vacuum(grace=-1)
    assert contents.read().count() == len(seen) + 50


def test_later_steps_may_fail():
    def bad():
        raise KeyError("x")

    assert T.post_batch_refresh([("a", lambda: None, True), ("b", bad, False)]) == [("a", "ok"), ("b", "failed: KeyError")]
    with pytest.raises(KeyError):
        T.post_batch_refresh([("b", bad, True)])


def test_csv_parts_are_read_by_their_headers(spark, tmp_path):
    from freehold.sources.landing import scan_bulk_csv

    for name, text in {
        "t_1.csv": "a,b\n1,x\n2,\"two\nlines, and a \"\"quote\"\"\"\n", "t_2.csv": "﻿b, a ,more\ny,3,z\n", "t_3.csv": "b\nw\n", "t_4.csv": "", "t_summary_1.csv": "a,b\n9,9\n", "other.csv": "a,b\n8,8\n",
    }.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    out = scan_bulk_csv(spark, f"file://{tmp_path}", "t", ("a", "b"))
    assert [(r["a"], r["b"], r["file_name"]) for r in out.orderBy("seq").collect()] == [("1", "x", "t_1.csv"), ("2", 'two\nlines, and a "quote"', "t_1.csv"), ("3", "y", "t_2.csv"), (None, "w", "t_3.csv")]
    assert scan_bulk_csv(spark, f"file://{tmp_path}", "none", ("a", "b")).count() == 0
    with pytest.raises(ValueError):
        scan_bulk_csv(spark, f"file://{tmp_path}", "other", ("x", "y"))


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    """Cut at every few bytes, with quoted line breaks, doubled quotes and blank lines: the rows that one reader finds."""
    import csv
    import io
    import random

    from freehold.sources.landing import csv_records, scan_bulk_csv

    r = random.Random(11)
    word = lambda: "".join(r.choice(['a', 'b', ' ', ',', '"', "\n", "\n\n", 'é', '""']) for _ in range(r.randint(0, 9)))
    want = [(str(k), f"x{word()}y", f"z{word()}.") for k in range(300)]
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(("k", "first\nname", "v", "v"))  # a header with a break; of two columns of a name the last counts
    for k, (a, b, c) in enumerate(want):
        out.writerow((a, b, "other", c))
        text.write("\n" * (k % 7 == 0))
    (tmp_path / "t_1.csv").write_text(text.getvalue(), encoding="utf-8", newline="")
    (tmp_path / "t_2.csv").write_text("k,v\r\n1,\"a\r\nb\"\r\n", encoding="utf-8", newline="")
    for conf, value in (("spark.sql.files.maxPartitionBytes", "97"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(conf, value)
    try:
        got = scan_bulk_csv(spark, f"file://{tmp_path}", "t", ("k", "first\nname", "v")).orderBy("seq").collect()
        assert spark.read.text(f"file://{tmp_path}/t_1.csv").rdd.getNumPartitions() > 50
        assert csv_records(spark, [f"file://{tmp_path}/t_1.csv"]).where("record <> ''").count() == 301
    finally:
        for conf in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(conf)
    assert [tuple(x[:3]) for x in got] == [*want, ("1", None, "a\r\nb")]


@pytest.mark.parametrize("rows", [3, 100_000])
def test_ids_are_numbered_on_in_order(spark, rows, monkeypatch):
    from freehold.operators import upsert

    monkeypatch.setattr(upsert, "NUMBER_ROWS", rows)
    have = spark.createDataFrame([(7, "old")], "id bigint, name string")
    new = spark.createDataFrame([(f"n{i * 37 % 50:02d}",) for i in range(50)], "name string")
    got = {r["name"]: r["id"] for r in upsert.assign_ids(have, new, [F.col("name")]).collect()}
    assert got == {"old": 7, **{f"n{i:02d}": 8 + i for i in range(50)}}
    assert upsert.assign_ids(have, new.limit(0), [F.col("name")]).count() == 1


def test_sources_are_added_once(spark):
    from freehold.sources.sinks import source_table

    first = source_table(spark)
    assert first.count() == 6 and source_table(spark, first.where("id < 3")).count() == 6 and source_table(spark, first).exceptAll(first).count() == 0


def test_summary_scans_its_points_once(spark, tmp_path):
    from freehold.operators import series

    schema = "entity_id int, month date, usage string, sale_median_price_m2 double, sale_cnt bigint, rent_median_annual_m2 double, rent_cnt bigint"
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/points")
    plan = series.summarize(spark.read.parquet(f"file://{tmp_path}/points"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_pooled_points_hold_all_anchors(spark, monkeypatch):
    from freehold.operators import series

    monkeypatch.setattr(series, "POOL_PARTS", 5)
    rows = [(e, m, "U", 100.0 * (e * 31 % 17 + 1) + m, e % 5, 10.0 + e * m % 7, (e + m) % 4) for e in range(40) for m in range(30)]
    df = spark.createDataFrame(rows, "entity_id int, m int, usage string, sale_median_price_m2 double, sale_cnt bigint, rent_median_annual_m2 double, rent_cnt bigint").withColumn("month", F.expr("add_months(date '2020-01-01', m)")).drop("m")
    want = series.summarize(df, "usage").first().asDict()
    assert series.compare_usage(df).first().asDict() == want


def test_geometric_median_is_the_least_total_distance(spark):
    """Against brute force: no step from the median is better, and the spread is the percentile of distances to it."""
    import math
    import random

    import numpy as np

    from freehold.operators import places

    r = random.Random(4)
    groups = {g: [(55 + r.random(), 25 + r.random()) for _ in range(n)] for g, n in ((1, 1), (2, 2), (3, 7), (4, 40))}
    groups[5] = [(55.0, 25.0)] * 5 + [(55.5, 25.5), (55.1, 25.9)]  # the median is a point
    df = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps], "g int, lon double, lat double")
    got = {x["g"]: x for x in places.geometric_median(df, "g").collect()}
    assert set(got) == set(groups)

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    for g, ps in groups.items():
        at = (got[g]["lon"], got[g]["lat"])
        total = lambda c: sum(math.dist(c, p) for p in ps)  # noqa: B023, E731
        assert all(total(at) <= total((at[0] + dx, at[1] + dy)) + 1e-7 for dx in (-1e-3, 0, 1e-3) for dy in (-1e-3, 0, 1e-3))
        assert got[g]["n_points"] == len(ps) and got[g]["spread_p90_m"] == pytest.approx(np.percentile([metres(at, p) for p in ps], 90), abs=0.01)


def test_projects_take_the_better_point(spark):
    from freehold.operators import places

    projects = spark.createDataFrame([(1, 55.0, 25.0, "building_point"), (2, 54.0, 24.0, "area_centroid"), (3, None, None, None), (4, None, None, None)], "id int, lon double, lat double, geo_method string")
    found = spark.createDataFrame([(1, 9.0, 9.0, True), (2, 8.0, 8.0, True), (3, 7.0, 7.0, True), (4, 6.0, 6.0, False)], "id int, lon double, lat double, inside boolean")
    got = {r["id"]: (r["lon"], r["geo_method"]) for r in places.accept_project_points(projects, found).collect()}
    assert got == {1: (55.0, "building_point"), 2: (8.0, "validated"), 3: (7.0, "validated"), 4: (None, None)}


def test_facts_skip_files_for_either_entity(spark, tmp_path):
    """Of the files, few hold an area and few hold a project, by their own statistics; no row is lost."""
    import pyarrow.parquet as pq

    from freehold.sources.sinks import write_facts

    n = 20_000
    facts = spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) + 100).cast("int").alias("area_id"), F.when(F.col("id") % 9 != 0, F.pmod(F.xxhash64(F.col("id") + 7), F.lit(100)) + 100).alias("project_id"), F.expr("date_add(date '2020-01-01', cast(pmod(xxhash64(id + 3), 700) as int))").alias("day"))
    write_facts(facts, f"file://{tmp_path}/facts", "day", files=64)
    assert spark.read.parquet(f"file://{tmp_path}/facts").select(facts.columns).exceptAll(facts).count() == 0 == n - spark.read.parquet(f"file://{tmp_path}/facts").count()
    spans = {}
    for f in (tmp_path / "facts").rglob("*.parquet"):
        meta = pq.read_metadata(f)
        for i, name in enumerate(meta.schema.names):
            for g in range(meta.num_row_groups):
                st = meta.row_group(g).column(i).statistics
                spans.setdefault(name, []).append((st.min, st.max) if st is not None and st.has_min_max else (0, -1))
    share = {c: sum(a <= 140 <= b for a, b in spans[c]) / len(spans[c]) for c in ("area_id", "project_id")}
    assert len(spans["area_id"]) >= 60 and all(x < 0.6 for x in share.values()), share


def test_pages_by_cursor_are_one_sort(spark, tmp_path):
    """Walking all pages, with ties and nulls in mixed directions, gives every row once in order; the bound reaches the scan."""
    import random

    r = random.Random(9)
    rows_in = [(r.choice([None, 1, 2, 3]), r.choice([None, "a", "b'\"", "é"]), k) for k in range(57)]
    spark.createDataFrame(rows_in, "n int, s string, k bigint").write.parquet(f"file://{tmp_path}/t")
    t = spark.read.parquet(f"file://{tmp_path}/t")
    orders = [[H.Order("n", a, b), H.Order("s", c, d), H.Order("k", a)] for a, b, c, d in ((True, True, False, False), (False, False, True, True), (True, False, False, True), (False, True, True, False))]
    for order in orders:
        want = [x["k"] for x in t.orderBy(*[o.sort() for o in order]).collect()]
        got, cursor = [], None
        while True:
            page = H.page_after(t, order, 20, cursor).collect()
            got += [x["k"] for x in page]
            cursor = H.next_cursor(H.page_after(t, order, 20, cursor), order)
            assert cursor == page[-1]["cursor"]
            if not page[0]["has_more"]:
                break
        assert got == want
        assert H.page_after(t, order, 20, cursor).count() == 0
    first = H.page_after(t.where("n = 2"), [H.Order("n"), H.Order("k")], 1).first()["cursor"]
    plan = H.page_after(t, [H.Order("n"), H.Order("k")], 5, first)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,2)" in plan
    with pytest.raises(ValueError):
        H.page_after(t, orders[0], 5, first)
