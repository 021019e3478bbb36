"""Queries on tables of a few odd rows, held against their SQL."""

import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.fixture
def tables(tmp_path):
    """Tables of ten orders in two months; several line items share a natural key, some in all columns."""
    db = duckdb.connect()
    made = {
        "nation": "SELECT range::INT AS n_nationkey, concat('NATION_', range) AS n_name, (range % 5)::INT AS n_regionkey FROM range(25)",
        "customer": "SELECT range AS c_custkey, (range % 25)::INT AS c_nationkey FROM range(50)",
        "supplier": "SELECT range AS s_suppkey, concat('S', range) AS s_name, (range % 25)::INT AS s_nationkey FROM range(60)",
        "part": "SELECT range AS p_partkey, CASE range % 2 WHEN 0 THEN 'PROMO' ELSE 'SMALL' END AS p_type FROM range(8)",
        "orders": "SELECT range AS o_orderkey, range * 4 AS o_custkey, CASE range % 2 WHEN 0 THEN 'F' ELSE 'O' END AS o_orderstatus, 20000.5 + range AS o_totalprice, TIMESTAMP '1997-03-05' AS o_orderdate FROM range(10)",
        "lineitem": "SELECT i % 10 AS l_orderkey, i % 8 AS l_partkey, i % 60 AS l_suppkey, 1 + (i % 2)::INT AS l_linenumber, 20.0::DOUBLE AS l_quantity, 30000.0 + (i // 40) * 1000 AS l_extendedprice, 'A' AS l_returnflag, 'F' AS l_linestatus, CASE i % 10 WHEN 3 THEN TIMESTAMP '1998-02-03' ELSE TIMESTAMP '1997-03-04' END AS l_shipdate FROM (SELECT range % 80 AS i FROM range(120))",
    }
    for name, sql in made.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return f"{tmp_path}", db


def same_as_sql(spark, tables, name):
    folder, db = tables
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = lambda found: sorted(map(repr, found))
    got = [tuple(r) for r in entry.queries()[name](spark, folder).select(*columns).collect()]
    assert rows(got) == rows(want.fetchall())
    return got


def test_sales_of_one_natural_key_all_count(spark, tables):
    got = same_as_sql(spark, tables, "incremental_marts")
    assert sum(r[3] or 0 for r in got) == 120


def test_overlap_deals_its_rows_twice(spark, monkeypatch):
    """Every variant against pairs of rows, with nulls, copies and both zeros; no variant has a shuffle of its own."""
    from freehold.operators import quality

    days = [None, "2020-01-01", "2020-01-02", "2020-01-03", "2020-01-05"]
    rows = lambda n, step: [(days[i * step % 5], [None, 1, 2][i % 3], [0.0, -0.0, 1.001, 1.004, None][i // 2 % 5], [100.4, 99.6, None, 7.0][i // 3 % 4]) for i in range(n)]
    kind = "d string, area_id int, size double, price double"
    a, b = (spark.createDataFrame(rows(n, k), kind).selectExpr("to_date(d) AS day", "area_id", "size", "price") for n, k in ((70, 1), (23, 3)))
    key = lambda r: (r["day"], r["area_id"], None if r["size"] is None else round(r["size"], 2), None if r["price"] is None else round(r["price"]))
    ka, kb = [key(r) for r in a.collect()], [key(r) for r in b.collect()]
    same = lambda x, y, drop=(): all(x[i] is not None and x[i] == y[i] for i in range(4) if i not in drop)
    fits = {"all": same, "within_a_day": lambda x, y: same(x, y, (0,)) and None not in (x[0], y[0]) and abs((x[0] - y[0]).days) <= 1}
    fits |= {f"without_{n}": lambda x, y, i=i: same(x, y, (i,)) for i, n in enumerate(("day", "area_id", "size", "price"))}
    out = quality.source_overlap(a, b)
    got = {r["variant"]: (r["row_count"], r["matched"]) for r in out.collect()}
    assert got == {n: (70, sum(any(f(x, y) for y in kb) for x in ka)) for n, f in fits.items()}
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") <= 4  # a dealing each, and at most one total


def test_an_upsert_makes_its_rows_once(spark, tmp_path):
    """A batch's rows are made once, however often the upsert reads them: a stream's stateful steps don't run anew."""
    from pyspark.sql import types as T

    from freehold.sources.layers import Layers

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = Layers(spark, f"file://{tmp_path}/t", T.StructType.fromDDL("k bigint, v bigint"), ("k",), F.expr("pmod(k, 3)"))
    rows = spark.range(0, 40, 1, 2).selectExpr("id AS k", "id * 2 AS v").mapInArrow(seen, "k bigint, v bigint")
    changed = table.upsert(rows, ("v",), "load", 0)
    assert changed.count() == 40 == table.read().count() and made.value == 40


def test_lines_without_breaks_are_records_as_they_are(spark, tmp_path):
    """Files whose quotes close on every line pass no Python; where records have breaks, blocks of any cut give the same ones."""
    from freehold.sources.landing import csv_records, scan_bulk_csv

    (tmp_path / "a.csv").write_text('k,v\n1,"x, ""y"""\n\n2,z\r\n')
    plain = csv_records(spark, [f"file://{tmp_path}/a.csv"])
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan
    rows = [(str(i), f"{'long ' * (i % 7)}line\n\n\"{i}\",\nend" if i % 3 else f"v{i}") for i in range(300)]
    text = "k,v\n" + "".join('{},"{}"\n'.format(k, v.replace('"', '""')) for k, v in rows)
    (tmp_path / "b.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "501", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = scan_bulk_csv(spark, f"file://{tmp_path}", "b", ("k", "v")).orderBy("seq").select("k", "v").collect()
            assert [tuple(r) for r in got] == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in scan_bulk_csv(spark, f"file://{tmp_path}", "a", ("k", "v")).select("k", "v").collect()] == [("1", 'x, "y"'), ("2", "z")]


def test_facts_are_made_once_to_be_laid_out(spark, tmp_path):
    """Facts are made once, however often they are read for their order; ranks are the number of bounds below a value."""
    from freehold.sources import sinks

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    facts = spark.range(0, 300, 1, 2).selectExpr("id", "cast(id % 7 as int) AS area_id", "nullif(id % 11, 0) AS project_id", "date_add(date '2020-01-01', cast(id as int)) AS day").mapInArrow(seen, "id bigint, area_id int, project_id bigint, day date")
    sinks.write_facts(facts, f"file://{tmp_path}/facts", "day", files=4)
    assert made.value == 300 == spark.read.parquet(f"file://{tmp_path}/facts").select("id").distinct().count()
    steps = [-1.5, 0.0, 2.0, 2.5, 9.0]
    values = [None, float("nan"), float("-inf"), -1.5, -1.4, -0.0, 2.0, 2.1, 9.0, 9.1]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", sinks._rank(F.col("v"), steps).alias("r")).collect()
    assert [r["r"] for r in got] == [0, 5, 0, 0, 1, 1, 2, 3, 4, 5]


def test_an_upsert_writes_its_rows_once_and_leaves_no_copies(spark, tmp_path, monkeypatch):
    """What is laid on top is what is given back; buckets one at a time change the same rows, updates tell what was."""
    from pyspark.sql import types as T

    from freehold.sources import layers

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    copies = lambda: {p.name for p in pathlib.Path(shared).iterdir() if p.name.startswith("incoming-")}
    before = copies()
    for rows, few in ((600_000, 100_000), (1, 0)):
        monkeypatch.setattr(layers, "PASS_ROWS", rows)
        monkeypatch.setattr(layers, "FEW_ROWS", few)
        table = layers.Layers(spark, f"file://{tmp_path}/t{rows}", T.StructType.fromDDL("k bigint, v bigint"), ("k",), F.expr("pmod(k, 3)"))
        table.upsert(spark.range(30).selectExpr("id AS k", "id AS v"), ("v",), "load", 0)
        assert len([p for p in (tmp_path / f"t{rows}/data").iterdir()]) == 1
        second = spark.range(20, 40).selectExpr("id AS k", "id + id % 2 AS v")
        changed = table.upsert(second, ("v",), "load", 1)
        want = {(k, k + k % 2, "update" if k < 30 else "insert", k if k < 30 else None) for k in range(20, 40) if k >= 30 or k % 2}
        got = lambda c: {(r["k"], r["v"], r["action"], r["was"] and r["was"]["v"]) for r in c.collect()}
        assert got(changed) == want == got(table.upsert(second, ("v",), "load", 1))  # a replay gives it again
        assert {tuple(r) for r in table.read().collect()} == {(k, k + k % 2 if k >= 20 else k) for k in range(40)}
    assert copies() == before
