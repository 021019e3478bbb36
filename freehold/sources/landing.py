"""Reading landed exports and gateway pages, and mapping their rows to facts. Schemas are declared, never inferred."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean as C
from ..operators.areas import LOOKUP_ROWS
from .work import kept

SALE_COLUMNS = ("transaction_id", "instance_date", "actual_worth", "trans_group_en", "procedure_name_en", "reg_type_en", "property_usage_en", "property_type_en", "property_sub_type_en", "rooms_en", "has_parking", "area_name_en", "area_name_ar", "project_name_en", "project_name_ar", "master_project_en", "building_name_en", "building_name_ar", "procedure_area")
RENT_COLUMNS = ("contract_id", "line_number", "no_of_prop", "contract_start_date", "contract_end_date", "annual_amount", "contract_amount", "actual_area", "contract_reg_type_en", "is_free_hold", "property_usage_en", "ejari_property_type_en", "ejari_property_sub_type_en", "area_name_en", "area_name_ar", "project_name_en", "project_name_ar", "master_project_en")
BUILDING_COLUMNS = ("building_number", "area_name_en", "project_name_en", "built_up_area", "floors", "flats", "offices", "shops", "car_parks", "elevators", "swimming_pools", "is_free_hold", "rooms_en")
GATEWAY_SALE = ("TRANSACTION_NUMBER", "INSTANCE_DATE", "TRANS_VALUE", "GROUP_EN", "PROCEDURE_EN", "IS_OFFPLAN", "IS_FREE_HOLD", "USAGE_EN", "PROP_TYPE_EN", "PROP_SB_TYPE_EN", "ROOMS_EN", "PARKING", "AREA_EN", "PROJECT_EN", "MASTER_PROJECT_EN", "PARCEL_ID", "ACTUAL_AREA")
GATEWAY_RENT = ("REGISTRATION_DATE", "START_DATE", "END_DATE", "VERSION_EN", "IS_FREE_HOLD", "USAGE_EN", "PROP_TYPE_EN", "PROP_SUB_TYPE_EN", "ROOMS", "AREA_EN", "PROJECT_EN", "PARCEL_ID", "ACTUAL_AREA", "ANNUAL_AMOUNT", "CONTRACT_AMOUNT", "CONTRACT_NUMBER")
PROJECT_FIELDS = ("PROJECT_NUMBER", "PROJECT_EN", "PROJECT_AR", "AREA_EN", "AREA_AR", "MASTER_PROJECT_EN", "DEVELOPER_NUMBER", "DEVELOPER_EN", "DEVELOPER_AR", "PROJECT_STATUS", "PRJ_TYPE_EN", "PROJECT_VALUE", "START_DATE", "END_DATE", "COMPLETION_DATE", "PERCENT_COMPLETED", "CNT_UNIT", "CNT_VILLA", "CNT_BUILDING", "DESCRIPTION_EN")


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv_headers(spark: SparkSession, pattern: str, skip: str = "") -> dict[str, tuple[str, ...]]:
    """path -> column names of each CSV file that matches; one short read a file, through Hadoop's file systems.

    Files whose name begins with skip are left out. A byte order mark, blanks
    around a name and quotes go; a quoted name may hold a line break; an empty
    file has no names.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    glob = jvm.org.apache.hadoop.fs.Path(pattern)
    out = {}
    for status in glob.getFileSystem(conf).globStatus(glob) or ():
        path = status.getPath()
        if skip and path.getName().startswith(skip):
            continue
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(path.getFileSystem(conf).open(path), "UTF-8"))
        try:
            text = reader.readLine() or ""
            while text.count('"') % 2:  # inside a quoted name
                more = reader.readLine()
                if more is None:
                    break
                text += "\n" + more
        finally:
            reader.close()
        out[path.toString()] = tuple(n.strip() for n in next(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")), []))
    return out


def _record_lines(edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (path, file_name, block, line, value, odd, start), a block's in order, to the records that lie whole in a block; or, with edges, to the lines of all others.

    start is the number of lines of an odd count of quotes before the block.
    until is null for a whole record; for a line of another one, those before the line.
    """
    names = ["path", "file_name", "block", "line", "record", "until"]

    def told(rows: pa.Table, until: np.ndarray | None) -> pa.RecordBatch:
        columns = [rows.column(c).combine_chunks() for c in ("path", "file_name", "block", "line", "value")]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64()) if until is None else pa.array(until)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, at = None, 0, None  # lines of a record that isn't at its end, odd lines up to here, and the block

        def rest() -> Iterator[pa.RecordBatch]:
            if edges and held is not None and len(held):
                odd = held.column("odd").to_numpy()
                yield told(held, count - int(odd.sum()) + np.cumsum(odd) - odd)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            file, block = table.column("path").combine_chunks().dictionary_encode(), table.column("block").to_numpy()
            of = file.indices.to_numpy()
            turns = np.flatnonzero((of[1:] != of[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(table)], strict=True):
                here, rows = (file.dictionary[of[lo]].as_py(), int(block[lo])), table.slice(lo, hi - lo)
                if here != at:
                    yield from rest()
                    held, count, at = None, int(rows.column("start")[0].as_py()), here
                if held is not None:
                    count -= int(held.column("odd").to_numpy().sum())
                    rows = pa.concat_tables([held, rows])
                odd = rows.column("odd").to_numpy()
                until = count + np.cumsum(odd) - odd
                count = int(until[-1] + odd[-1])
                begins = np.flatnonzero(until % 2 == 0)
                first = int(begins[0]) if len(begins) else len(rows)
                if edges and first:
                    yield told(rows.slice(0, first), until[:first])
                last = int(begins[-1]) if len(begins) and count % 2 else len(rows)
                held = rows.slice(last) if last < len(rows) else None
                begins = begins[begins < last]
                if not edges and len(begins):
                    out = rows
                    if len(begins) < last - first:
                        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, last), pa.int32()), rows.column("value").combine_chunks())
                        out = rows.take(pa.array(begins)).drop_columns("value").append_column("value", pc.binary_join(lists, "\n"))
                    else:
                        out = rows.slice(first, last - first)
                    yield told(out, None)
        yield from rest()

    return run


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, file_name, block, line, record): every record of CSV files as its text, wherever its files were cut.

    A line break is a record's end where the quotes before it are even in
    number. Blocks of a file are read by tasks of their own. A first pass counts
    each block's lines of odd quotes, so that a second one knows at a block's
    start whether it is inside a quoted value. Where no file has such a line,
    every line is a record. Else records that lie in one block are
    put together where they are read, and only lines of those that blocks cut
    are brought together by a shuffle. (block, line) orders records in a file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = kept(_lines(spark, paths).withColumn("odd", F.when(F.contains("value", F.lit('"')), quotes % 2).otherwise(0)).groupBy("path", "block").agg(F.sum("odd").alias("n")), "blocks")
    if blocks.where("n > 0").isEmpty():
        return _lines(spark, paths).withColumnRenamed("value", "record")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
    starts = F.broadcast(blocks.select("path", "block", before.alias("start")))
    unknown = F.raise_error(F.lit("a file was cut at other places than before")).cast("bigint")
    lines = _lines(spark, paths).withColumn("odd", (quotes % 2).cast("bigint")).join(starts, ["path", "block"], "left")
    lines = lines.select("path", "file_name", "block", "line", "value", "odd", F.coalesce("start", unknown).alias("start"))
    schema = "path string, file_name string, block bigint, line bigint, record string, until bigint"
    whole = lines.mapInArrow(_record_lines(False), schema).drop("until")
    parts = lines.mapInArrow(_record_lines(True), schema).groupBy("path", "file_name", F.floor(F.col("until") / 2).alias("_record")).agg(F.array_sort(F.collect_list(F.struct("block", "line", "record"))).alias("parts"))
    first = F.col("parts")[0]
    return whole.unionByName(parts.select("path", "file_name", first["block"].alias("block"), first["line"].alias("line"), F.array_join("parts.record", "\n").alias("record")))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return (
        spark.read.option("lineSep", "\n")
        .text(list(paths))
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    )


def scan_bulk_csv(spark: SparkSession, root: str, dataset: str, columns: Sequence[str]) -> DataFrame:
    """Every part <dataset>*.csv under root as strings, with file_name and seq, which orders rows by file and place.

    Columns are found by each file's own header: parts may order them
    differently, a column that a part lacks is null there, more columns are
    left out, and of columns of one name the last counts. A part with none of
    the columns is refused. Quoted values may hold line breaks and doubled
    quotes; a part of any size is read by many tasks. Blank lines are no rows.
    Files named <dataset>_summary* belong to another dataset.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path, header in csv_headers(spark, f"{root}/{dataset}*.csv", f"{dataset}_summary").items():
        if header:
            layouts.setdefault(header, []).append(path)
    out = None
    for header, paths in sorted(layouts.items()):
        if not set(header) & set(columns):
            raise ValueError(f"no known column in the header of {', '.join(sorted(paths))}")
        places = ", ".join(f"c{i} string" for i in range(len(header)))  # names may repeat
        records = csv_records(spark, sorted(paths)).withColumn("record", F.regexp_replace("record", "\\r$", "")).where(F.trim("record") != "")
        # a file's first record is its header
        at = {n: i for i, n in enumerate(header)}
        parsed = _without_headers(records, sorted(paths)).withColumn("r", F.from_csv("record", places, {"escape": '"', "maxCharsPerColumn": "-1"}))
        one = parsed.select(*[(F.col(f"r.c{at[c]}") if c in at else F.lit(None).cast("string")).alias(c) for c in columns], "file_name", F.struct("block", "line").alias("place"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], T.StructType([*strings((*columns, "file_name")).fields, *T.StructType.fromDDL("place struct<block:bigint,line:bigint>").fields]))
    return out.withColumn("seq", F.struct("file_name", "place")).drop("place")


def _without_headers(records: DataFrame, paths: Sequence[str]) -> DataFrame:
    """records of these files less each file's first one, which begins at the first line of its first block that isn't blank."""
    lines = _lines(records.sparkSession, paths).where("block = 0").where(F.trim(F.regexp_replace("value", "\\r$", "")) != "")
    first = lines.groupBy("path").agg(F.min("line").alias("_first"))  # a row a file
    first = F.broadcast(first) if len(paths) <= LOOKUP_ROWS else first
    return records.join(first, "path", "left").where((F.col("block") > 0) | (F.col("line") > F.col("_first"))).drop("_first")


def scan_gateway_json(pages: DataFrame, column: str = "value") -> DataFrame:
    """Envelope texts, one page a row, to one row (payload JSON) a result; a page with another code than 200 gives none."""
    code = F.get_json_object(column, "$.responseCode").try_cast("int")
    rows = F.from_json(F.get_json_object(column, "$.response.result"), "array<map<string,string>>")
    return pages.where(code == 200).select(F.explode(rows).alias("r")).select(F.to_json("r").alias("payload"))


def _named(name: Column) -> Column:
    return C.norm_name(name)


def map_bulk_sale(rows: DataFrame) -> DataFrame:
    """Facts with ``valid``: a transaction id, an ISO date, an amount and an area name."""
    c = F.col
    out = rows.select(
        "*",
        F.lit(1).alias("source_id"), C.to_text(c("transaction_id")).alias("txn_number"), C.txn_key_bulk(c("transaction_id")).alias("txn_key"), C.to_iso_date(c("instance_date")).alias("txn_date"),
        F.coalesce(C.to_text(c("trans_group_en")), F.lit("Unknown")).alias("txn_group"), C.to_text(c("procedure_name_en")).alias("procedure"), C.is_offplan_bulk(c("reg_type_en")).alias("is_offplan"), C.freehold("bulk_sale").alias("is_freehold"),
        C.to_text(c("property_usage_en")).alias("usage"), _named(c("area_name_en")).alias("area_name"), _named(c("project_name_en")).alias("project_name"), _named(c("building_name_en")).alias("building_name"),
        C.to_float(c("procedure_area")).cast("decimal(12,2)").alias("actual_area_m2"), C.to_float(c("actual_worth")).cast("decimal(14,2)").alias("amount_aed"),
    )
    out = out.withColumn("price_per_m2", C.per_m2(F.col("amount_aed"), F.col("actual_area_m2")))
    return out.withColumn("valid", F.col("txn_number").isNotNull() & F.col("txn_date").isNotNull() & F.col("amount_aed").isNotNull() & F.col("area_name").isNotNull())


def map_bulk_rent(rows: DataFrame) -> DataFrame:
    """Facts with ``valid``: contract, line, start, annual amount and area name. Amounts are per property."""
    c = F.col
    n = C.to_float(c("no_of_prop"))
    each = lambda x: C.per_property(C.to_float(c(x)), n).cast("decimal(14,2)")
    out = rows.select(
        "*",
        F.lit(1).alias("source_id"), F.when(C.to_text(c("contract_id")).isNotNull() & C.to_text(c("line_number")).isNotNull(), F.concat_ws(":", F.trim("contract_id"), F.trim("line_number"))).alias("source_ref"),
        C.to_iso_date(c("contract_start_date")).alias("start_date"), C.to_iso_date(c("contract_end_date")).alias("end_date"), F.lit(None).cast("date").alias("registration_date"), C.to_text(c("contract_reg_type_en")).alias("version"),
        C.freehold("bulk_rent", c("is_free_hold")).alias("is_freehold"), C.to_text(c("property_usage_en")).alias("usage"), C.to_text(c("ejari_property_sub_type_en")).alias("rooms"), _named(c("area_name_en")).alias("area_name"), _named(c("project_name_en")).alias("project_name"),
        C.to_float(c("actual_area")).cast("decimal(12,2)").alias("actual_area_m2"), each("annual_amount").alias("annual_amount_aed"), each("contract_amount").alias("contract_amount_aed"),
    )
    out = out.withColumn("rent_per_m2_year", C.per_m2(F.col("annual_amount_aed"), F.col("actual_area_m2")))
    return out.withColumn("valid", F.col("source_ref").isNotNull() & F.col("start_date").isNotNull() & F.col("annual_amount_aed").isNotNull() & F.col("area_name").isNotNull())


def _payload(staged: DataFrame, fields: Sequence[str]) -> DataFrame:
    return staged.withColumn("p", F.from_json("payload", strings(fields)))


def map_gateway_sale(staged: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"p.{n}")
    out = _payload(staged, GATEWAY_SALE).select(
        F.lit(2).alias("source_id"), C.to_text(c("TRANSACTION_NUMBER")).alias("txn_number"), C.txn_key_gateway(c("TRANSACTION_NUMBER")).alias("txn_key"), C.to_iso_date(c("INSTANCE_DATE")).alias("txn_date"), F.coalesce(C.to_text(c("GROUP_EN")), F.lit("Unknown")).alias("txn_group"),
        C.to_bool(c("IS_OFFPLAN")).alias("is_offplan"), C.freehold("gateway_sale", c("IS_FREE_HOLD")).alias("is_freehold"), C.to_text(c("USAGE_EN")).alias("usage"), _named(c("AREA_EN")).alias("area_name"), _named(c("PROJECT_EN")).alias("project_name"),
        C.to_float(c("ACTUAL_AREA")).cast("decimal(12,2)").alias("actual_area_m2"), C.to_float(c("TRANS_VALUE")).cast("decimal(14,2)").alias("amount_aed"),
    )
    return out.withColumn("valid", F.col("txn_number").isNotNull() & F.col("txn_date").isNotNull() & F.col("amount_aed").isNotNull() & F.col("area_name").isNotNull())


def map_gateway_rent(staged: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"p.{n}")
    ref = C.joined_ref([F.substring(c("REGISTRATION_DATE"), 1, 10), c("AREA_EN"), c("ANNUAL_AMOUNT"), c("ACTUAL_AREA"), F.substring(c("START_DATE"), 1, 10), F.substring(c("END_DATE"), 1, 10)])
    out = _payload(staged, GATEWAY_RENT).select(
        F.lit(2).alias("source_id"), ref.alias("source_ref"), C.to_iso_date(c("REGISTRATION_DATE")).alias("registration_date"), C.to_iso_date(c("START_DATE")).alias("start_date"), C.to_iso_date(c("END_DATE")).alias("end_date"), C.to_text(c("VERSION_EN")).alias("version"), C.freehold("gateway_rent", c("IS_FREE_HOLD")).alias("is_freehold"),
        C.to_text(c("USAGE_EN")).alias("usage"), _named(c("AREA_EN")).alias("area_name"), _named(c("PROJECT_EN")).alias("project_name"), C.to_float(c("ACTUAL_AREA")).cast("decimal(12,2)").alias("actual_area_m2"), C.to_float(c("ANNUAL_AMOUNT")).cast("decimal(14,2)").alias("annual_amount_aed"),
    )
    return out.withColumn("valid", F.col("registration_date").isNotNull() & F.col("annual_amount_aed").isNotNull() & F.col("area_name").isNotNull())


def map_project(staged: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"p.{n}")
    dates = [C.to_iso_date(c(n)).alias(n.lower()) for n in ("START_DATE", "END_DATE", "COMPLETION_DATE")]
    counts = [C.to_int(c(n)).alias(n.lower()) for n in ("CNT_UNIT", "CNT_VILLA", "CNT_BUILDING")]
    texts = [C.to_text(c(n)).alias(n.lower()) for n in ("PROJECT_STATUS", "PRJ_TYPE_EN", "DESCRIPTION_EN", "PROJECT_AR", "AREA_AR", "DEVELOPER_AR")]
    names = [_named(c(n)).alias(n.lower()) for n in ("PROJECT_EN", "AREA_EN", "MASTER_PROJECT_EN", "DEVELOPER_EN")]
    return _payload(staged, PROJECT_FIELDS).select(C.to_int(c("PROJECT_NUMBER")).alias("project_number"), C.to_int(c("DEVELOPER_NUMBER")).alias("developer_number"), *names, *texts, C.to_float(c("PROJECT_VALUE")).cast("decimal(16,2)").alias("project_value"), C.to_float(c("PERCENT_COMPLETED")).cast("decimal(5,2)").alias("percent_completed"), *dates, *counts)


def map_area_lookup(staged: DataFrame) -> DataFrame:
    p = _payload(staged, ("AREA_ID", "NAME_EN", "NAME_AR"))
    return p.select(C.to_int(F.col("p.AREA_ID")).alias("code"), _named(F.col("p.NAME_EN")).alias("name_en"), C.to_text(F.col("p.NAME_AR")).alias("name_ar"))


def map_building_register(rows: DataFrame, areas: DataFrame, projects: DataFrame) -> DataFrame:
    """Register rows with ids and ``valid``: a name that isn't '0', and a known area; an unknown project is null."""
    name = C.norm_name(F.col("building_number"))
    out = rows.withColumn("name_en", F.when(name != "0", name)).withColumn("_area", _named(F.col("area_name_en"))).withColumn("_project", _named(F.col("project_name_en")))
    out = out.join(areas.select(F.col("id").alias("area_id"), F.col("name_en").alias("_area")), "_area", "left").join(projects.select(F.col("id").alias("project_id"), F.col("name_en").alias("_project")), "_project", "left").drop("_area", "_project")
    numbers = {n: C.to_int(F.col(n)) for n in ("floors", "flats", "offices", "shops", "car_parks", "elevators", "swimming_pools")}
    return out.withColumns(numbers).withColumn("built_up_area", C.to_float(F.col("built_up_area")).cast("decimal(12,2)")).withColumn("is_free_hold", C.to_bool(F.col("is_free_hold"))).withColumn("valid", F.col("name_en").isNotNull() & F.col("area_id").isNotNull())


def reject_accounting(mapped: DataFrame, by: Sequence[str] = ("file_name",)) -> DataFrame:
    """Rows read, written and skipped by file."""
    return mapped.groupBy(*by).agg(F.count("*").alias("rows_read"), F.count_if("valid").alias("rows_written"), F.count_if(~F.col("valid")).alias("rows_skipped"))
