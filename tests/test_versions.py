"""Versions of tables, layered upserts, marts by what changed, and streamed counts and metrics, against whole recomputation."""

import datetime as dt
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from freehold.operators import marts as M
from freehold.operators import refresh as R
from freehold.plans import analytics
from freehold.sources import layers as Y
from freehold.sources import snapshots as N
from freehold.streaming import feed as T


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/table"


def values(df):
    return sorted(tuple(r) for r in df.collect())


# ---- snapshots


def test_a_number_is_given_once(spark, root):
    files = N.Files(spark)
    assert files.put_new(f"{root}/1.json", "a") and not files.put_new(f"{root}/1.json", "b")
    assert files.read(f"{root}/1.json") == "a" and files.names(root) == ["1.json"]


def test_readers_see_whole_versions(spark, root):
    """While a table is rebuilt over and over, a reader finds one version or another, never none and never a mixture."""
    N.publish_snapshot(spark.range(50).select(F.lit(0).alias("v")), root)
    seen, stop, wrong = set(), threading.Event(), []

    def read():
        while not stop.is_set():
            try:
                got = [r[0] for r in N.read_snapshot(spark, root).collect()]
                seen.add(got[0])
                if len(got) != 50 or len(set(got)) != 1:
                    wrong.append(got)
            except Exception as error:
                wrong.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 9):
        N.publish_snapshot(spark.range(50).select(F.lit(v).alias("v")), root)
    stop.set()
    reader.join()
    assert not wrong and len(seen) > 1
    assert N.vacuum_snapshots(spark, root) == []  # all still young
    assert len(N.vacuum_snapshots(spark, root, grace=-1)) == 8 and values(N.read_snapshot(spark, root))[0] == (8,)


def test_two_writers_lose_nothing(spark, root):
    table = N.Versions(spark, root)

    def add(name):
        for _ in range(5):
            table.publish(lambda now: {"names": [*now.get("names", []), name]})

    both = [threading.Thread(target=add, args=(n,)) for n in "ab"]
    [t.start() for t in both]
    [t.join() for t in both]
    number, now = table.current()
    assert number == 10 and sorted(now["names"]) == ["a"] * 5 + ["b"] * 5
    assert table.publish(lambda now: None) == now


def test_no_version_yet(spark, root):
    with pytest.raises(FileNotFoundError):
        N.read_snapshot(spark, root)


def test_a_failed_build_leaves_the_version_before(spark, root):
    N.publish_snapshot(spark.range(3), root)
    with pytest.raises(Exception, match="boom"):
        N.publish_snapshot(spark.range(3).select(F.raise_error(F.lit("boom")).alias("x")), root)
    assert N.read_snapshot(spark, root).count() == 3


def test_stored_marts_follow_their_tables(spark, tmp_path):
    """Rows removed from a table at the same path, in one session: the next read is of the new rows; an unchanged table isn't read again."""
    source = "/root/testdata/sf0.001"
    sf = f"file://{tmp_path}/sf"
    for t in analytics.MART_TABLES:
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    first = values(analytics.stored_areas(spark, sf).select("area_id", "month", "usage", "sale_cnt"))
    again = analytics.stored(spark, sf, "area-monthly", lambda *_: pytest.fail("nothing changed"))
    assert values(again.select("area_id", "month", "usage", "sale_cnt")) == first
    spark.read.parquet(f"{source}/lineitem.parquet").where("l_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{sf}/lineitem.parquet")
    then = analytics.stored_areas(spark, sf)
    assert values(then.select("area_id", "month", "usage", "sale_cnt")) == values(analytics.area_mart(spark, sf).select("area_id", "month", "usage", "sale_cnt")) != first


# ---- layers

ROWS = "source int, n int, day date, amount int, note string"


def test_layers_equal_a_dictionary(spark, root):
    """Random upserts with null keys, compactions and replays, against a plain dictionary."""
    schema = T.schema_of(ROWS)
    table = Y.Layers(spark, root, schema, ("source", "n", "day"), F.year("day"), compact_after=2)
    held, r = {}, random.Random(5)
    for batch in range(7):
        rows = {(r.choice([1, None]), r.choice([None, 1, 2, 3]), r.choice([None, dt.date(1998, 5, 1), dt.date(1999, 5, r.randint(1, 2))])): (r.randint(1, 2), f"b{batch}") for _ in range(9)}
        frame = spark.createDataFrame([(*k, *v) for k, v in rows.items()], schema)
        want = {}
        for k, v in rows.items():
            if k not in held:
                want[k] = ("insert", None)
                held[k] = v
            elif held[k][0] != v[0]:
                want[k] = ("update", held[k][0])
                held[k] = (v[0], held[k][1])
        for _ in range(2):  # the second time is a replay
            changed = table.upsert(frame, ("amount",), "s", batch)
            assert {(x["source"], x["n"], x["day"]): (x["action"], x["was"] and x["was"]["amount"]) for x in changed.collect()} == want
        assert {(x["source"], x["n"], x["day"]): (x["amount"], x["note"]) for x in table.read().collect()} == held
        assert all(len(x["deltas"]) <= 2 for x in table.versions.current()[1]["buckets"].values())
    assert table.upsert(frame, ("amount",), "s", 3) is None
    table.compact("1998", always=True)
    assert table.vacuum() == [] and table.vacuum(grace=-1)
    assert {(x["source"], x["n"], x["day"]): (x["amount"], x["note"]) for x in table.read().collect()} == held


def test_what_is_written_follows_the_batch(spark, root):
    schema = T.schema_of("n bigint, day date, amount bigint")
    day = F.expr("date_add(date '1990-01-01', cast(id % 3650 as int))")
    table = Y.Layers(spark, root, schema, ("n", "day"), F.year("day"))
    table.replace(lambda _: spark.range(200_000).select(F.col("id").alias("n"), day.alias("day"), F.col("id").alias("amount")), ())
    size = lambda: sum(n for _, n, _ in N.Files(spark).listing([f"{root}/data"]))
    before, manifest = size(), table.versions.current()[1]
    batch = spark.range(40).select((F.col("id") * 3650).alias("n"), F.lit(dt.date(1990, 1, 1)).alias("day"), F.lit(-1).cast("bigint").alias("amount"))
    table.upsert(batch, ("amount",), "s", 0)
    assert size() - before < before / 20
    after = table.versions.current()[1]
    assert {b for b in after["buckets"] if after["buckets"][b] != manifest["buckets"][b]} == {"1990"}
    files = table.read(["1990"]).inputFiles()
    assert files and all("_bucket=1990" in f for f in files)
    assert table.read().where("amount = -1").count() == 40 and table.read().count() == 200_000
    table.upsert(batch, ("amount",), "s", 1)  # nothing differs
    assert table.versions.current()[1]["buckets"] == after["buckets"]


# ---- marts by what changed


def brute_mart(rows, rents, canon):
    """(area, month, usage) -> (sales, median, rents, median) from plain lists."""
    cells = {}
    for kind, facts in (("s", rows), ("r", rents)):
        for f in facts:
            cells.setdefault((canon(f), f["day"].replace(day=1), f["usage"] or "Unknown"), {"s": [], "r": []})[kind].append(f["v"])
    med = lambda v: None if not v else (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    return {k: (len(c["s"]) or None, med(c["s"]), len(c["r"]) or None, med(c["r"])) for k, c in cells.items()}


def test_mart_follows_random_changes(spark, root):
    r = random.Random(8)
    sale_schema = T.schema_of("k int, txn_date date, area_id int, project_id bigint, usage string, price_per_m2 double, txn_group string")
    rent_schema = T.schema_of("k int, start_date date, area_id int, project_id bigint, usage string, rent_per_m2_year double")
    projects = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, area_id int")
    actual = spark.createDataFrame([(1, 1, 9)], "project_id bigint, old_area_id int, new_area_id int")
    looks = [R.Lookups(projects, spark.createDataFrame(e, "old_area_id int, new_area_id int, reviewed boolean"), actual) for e in ([(3, 4, True)], [(3, 4, False), (1, 9, True), (5, 6, True)])]
    canons = [lambda f: {1: 1, 2: 2}.get(f["project"], {3: 4}.get(f["area"], f["area"])), lambda f: {1: 9, 2: 2}.get(f["project"], {1: 9, 5: 6}.get(f["area"], f["area"]))]
    mart = R.AreaMart(spark, root, R.sale_side(lambda f: f.where("txn_group = 'Sales'")), R.rent_side(lambda f: f))
    facts = Y.Layers(spark, f"{root}-sales", sale_schema, ("k", "txn_date"), F.year("txn_date"))
    sales, rents, look = {}, [], 0

    def check():
        want = brute_mart([f for f in sales.values() if f["group"] == "Sales"], rents, canons[look])
        got = {(x["area_id"], x["month"], x["usage"]): (x["sale_cnt"], x["sale_median_price_m2"], x["rent_cnt"], x["rent_median_annual_m2"]) for x in mart.read().collect()}
        assert got == want

    def new(k):
        return {"day": dt.date(1997 + k % 3, 1 + k % 2, 5), "area": r.randint(1, 6), "project": r.choice([None, 1, 2, 3]), "usage": r.choice(["A", None]), "v": float(r.randint(1, 9)), "group": r.choice(["Sales", "Sales", "Gifts"])}

    for batch in range(4):
        rows = {k: new(k) for k in r.sample(range(30), 12)}
        if batch:
            rows = {k: f for k, f in rows.items() if f["day"].year != 1997}  # 1997 is left alone from now on
        before = mart.mart.versions.current()[1].get("buckets", {}).get("1997")
        frame = spark.createDataFrame([(k, f["day"], f["area"], f["project"], f["usage"], f["v"], f["group"]) for k, f in rows.items()], sale_schema)
        sales |= rows
        for _ in range(2):  # run again as after a failure
            changed = facts.upsert(frame, ("area_id", "project_id", "usage", "price_per_m2", "txn_group"), "s", batch)
            mart.add("sale", R.signed(changed, mart.sides["sale"]), looks[look], "s", batch)
        if batch:
            assert mart.mart.versions.current()[1]["buckets"].get("1997") == before
        more = [new(r.randrange(30)) for _ in range(6)]
        rents += more
        frame = spark.createDataFrame([(0, f["day"], f["area"], f["project"], f["usage"], f["v"]) for f in more], rent_schema)
        mart.add("rent", R.counted(frame, mart.sides["rent"]), looks[look], "r", batch)
        check()
        if batch == 1:
            mart.redirect(looks[0], looks[1])
            look = 1
            check()
    whole = M.area_monthly_mart(facts.read().where("txn_group = 'Sales'"), spark.createDataFrame([], rent_schema), *looks[1])
    assert values(whole.where("sale_cnt > 0").select("area_id", "month", "usage", "sale_cnt", "sale_p25_price_m2")) == values(mart.read().where("sale_cnt > 0").select("area_id", "month", "usage", "sale_cnt", "sale_p25_price_m2"))


# ---- the feed


def land(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("endpoint", "event_time", "record_hash"), x, strict=True))) for x in rows))


def test_counts_are_exact_over_restarts_and_late_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("ab"), f"2024-0{r.randint(1, 6)}-1{r.randint(0, 9)} 00:00:00", None) for _ in range(400)]
    rows = [(e, t, f"{t[5:7]}-{r.randint(0, 9)}") for e, t, _ in rows]
    table = T.counts_table(spark, f"file://{tmp_path}/counts")
    parts = [rows[:150], rows[150:200], rows[150:200], rows[200:]]  # one part comes twice
    stream = lambda: T.monthly_counts(T.stream_pages(spark, f"file://{tmp_path}/in", "endpoint string, event_time timestamp, record_hash string", 1))
    done = []
    for k, part in enumerate(parts):
        land(tmp_path, f"f{k}", part)
        done += part
        if k % 2:  # two files, two triggers a run
            T.run_counts(stream(), table, f"file://{tmp_path}/cp")
            want = {}
            for e, t, h in done:
                want.setdefault((e, dt.date(2024, int(t[5:7]), 1)), []).append(h)
            assert {(x["endpoint"], x["month"]): (x["fetched"], x["staged"]) for x in table.read().collect()} == {c: (len(h), len(set(h))) for c, h in want.items()}
    state = list((tmp_path / "cp" / "state").rglob("*.zip"))
    assert state  # RocksDB's snapshots


def test_months_are_let_go_with_a_lateness(spark, tmp_path):
    table = T.counts_table(spark, f"file://{tmp_path}/counts")
    for k, rows in enumerate(([("a", "2024-01-05 00:00:00", "x")], [("a", "2024-06-05 00:00:00", "y")], [("a", "2024-01-06 00:00:00", "late"), ("a", "2024-06-06 00:00:00", "z")])):
        land(tmp_path, f"f{k}", rows)
        events = T.stream_pages(spark, f"file://{tmp_path}/in", "endpoint string, event_time timestamp, record_hash string", 1)
        T.run_counts(T.monthly_counts(events, lateness="2 days"), table, f"file://{tmp_path}/cp")
    assert {str(x["month"]): x["fetched"] for x in table.read().collect()} == {"2024-01-01": 1, "2024-06-01": 2}


def test_metrics_count_every_batch_once(spark, tmp_path):
    """More batches than a query remembers itself, with a restart, and a batch told twice."""
    metrics = T.RunMetrics(spark, f"file://{tmp_path}/metrics")
    spark.streams.addListener(metrics)
    try:
        for first, last in ((0, 110), (110, 125)):
            for k in range(first, last):
                land(tmp_path, f"f{k:03d}", [("a", "2024-01-05 00:00:00", str(k))] * 2)
            events = T.stream_pages(spark, f"file://{tmp_path}/in", "endpoint string, event_time timestamp, record_hash string", 1).observe("seen", F.count("*").alias("n"))
            q = events.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
            metrics.wait(q)
    finally:
        spark.streams.removeListener(metrics)
    got = metrics.batches()
    assert got.count() == 125 and got.select("query").distinct().count() == 1
    assert got.agg(F.sum("rows"), F.sum(F.expr("bigint(observed['seen.n'])"))).first()[:] == (250, 250)
    first = got.orderBy("batch").first()
    assert not metrics.files.put_new(f"{metrics.root}/query={first['query']}/{first['batch']:010d}.json", "{}")
