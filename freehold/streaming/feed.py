"""The incremental feed as Structured Streaming: landed pages in, content staged once, facts upserted, counts by month."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.clean import record_hash
from ..operators.upsert import dedupe_natural_key
from ..sources.layers import Layers
from ..sources.snapshots import Files
from .staged import StagedContents

OVERLAP_DAYS, FIRST_RUN_DAYS = 2, 30


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def stream_pages(spark: SparkSession, root: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files under root since the checkpoint; schema as DDL."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(root)


def stream_dedupe(events: DataFrame, event_time: str = "event_time", overlap: str = f"{OVERLAP_DAYS} days") -> DataFrame:
    """Content once within the allowed lateness; state older than that goes. record_hash is the content."""
    return events.withWatermark(event_time, overlap).dropDuplicatesWithinWatermark(["record_hash"])


def hashed(events: DataFrame, endpoint: str, payload: str = "payload") -> DataFrame:
    return events.withColumn("record_hash", record_hash(F.lit(endpoint), F.col(payload)))


def run_to_end(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", rocksdb: bool = False) -> StreamingQuery:
    """All that has landed, then stop; the checkpoint is the cursor, and remembers which state store its query began with."""
    spark, conf = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    if rocksdb:
        spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return q


def staging_sink(contents: StagedContents, stream: str = "stage") -> Callable[[DataFrame, int], None]:
    """Adds what isn't staged yet; a replayed batch adds nothing."""
    return lambda batch, batch_id: contents.stage(batch, batch_id, stream) and None


def upsert_batch(facts: Layers, batch: DataFrame, update: Sequence[str], order: Sequence, stream: str, batch_id: int) -> DataFrame | None:
    """Lays a batch on the facts: last row a key, then a guarded upsert. What is written follows the batch; a replay does nothing."""
    return facts.upsert(dedupe_natural_key(batch, facts.key, order), update, stream, batch_id)


def event_cursor(runs: DataFrame, batch_max: DataFrame) -> DataFrame:
    """endpoint -> latest completed event date, which only moves forward."""
    both = runs.select("endpoint", "cursor").unionByName(batch_max.select("endpoint", "cursor"))
    return both.groupBy("endpoint").agg(F.max("cursor").alias("cursor"))


def overlap_window(cursors: DataFrame, today: str) -> DataFrame:
    """From two days before the cursor (thirty before today on a first run) to today."""
    t = F.lit(today).cast("date")
    return cursors.select("endpoint", F.coalesce(F.date_sub("cursor", OVERLAP_DAYS), F.date_sub(t, FIRST_RUN_DAYS)).alias("date_from"), t.alias("date_to"))


def month_windows(ranges: DataFrame) -> DataFrame:
    """Each range date_from to date_to cut at calendar months, both ends included; an empty range gives none."""
    months = F.when(F.col("date_from") <= F.col("date_to"), F.sequence(F.trunc("date_from", "month"), F.trunc("date_to", "month"), F.expr("interval 1 month")))
    out = ranges.select("*", F.explode(months).alias("_m"))
    return out.select(*[c for c in ranges.columns if c not in ("date_from", "date_to")], F.greatest("date_from", "_m").alias("date_from"), F.least("date_to", F.last_day("_m")).alias("date_to"))


COUNTS_SCHEMA = "endpoint string, month date, fetched bigint, staged bigint"


def monthly_counts(events: DataFrame, time: str = "event_time", lateness: str | None = None) -> DataFrame:
    """(endpoint, month, fetched, staged): rows that came, and contents (record_hash) that came for the first time.

    A content is staged in the month of its first row to arrive. In a stream
    two stateful steps follow each other: the hashes seen, and the sums of each
    month, which come out in update mode. Without ``lateness`` both are kept
    for ever and counts are exact however late a row comes. With it, a month's
    sums are let go once rows that much newer than the month's end have come;
    later rows of that month are dropped (and counted by the query's progress).
    """
    month = F.date_trunc("month", F.col(time).cast("timestamp"))
    rows = events.select("endpoint", "record_hash", month.alias("month"))
    if lateness:
        # a month's timestamp is its first instant, so its rows may come a month, and the lateness, after it
        rows = rows.withWatermark("month", f"31 days {lateness}")
    both = rows.select("endpoint", "month", F.lit(1).alias("fetched"), F.lit(0).alias("staged")).unionByName(
        rows.dropDuplicates(["endpoint", "record_hash"]).select("endpoint", "month", F.lit(0).alias("fetched"), F.lit(1).alias("staged"))
    )
    sums = both.groupBy("endpoint", "month").agg(F.sum("fetched").alias("fetched"), F.sum("staged").alias("staged"))
    return sums.select("endpoint", F.col("month").cast("date").alias("month"), "fetched", "staged")


def counts_table(spark: SparkSession, root: str) -> Layers:
    return Layers(spark, root, schema_of(COUNTS_SCHEMA), ("endpoint", "month"), F.year("month"))


def run_counts(counts: DataFrame, table: Layers, checkpoint: str, name: str = "monthly-counts") -> StreamingQuery:
    """Streams counts to the table until all that has landed is counted; state lives in RocksDB, a batch is laid on once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, ("fetched", "staged"), name, batch_id)

    return run_to_end(counts, handle, checkpoint, mode="update", rocksdb=True)


def post_batch_refresh(steps: Sequence[tuple[str, Callable[[], None], bool]]) -> list[tuple[str, str]]:
    """Runs (name, step, fatal) in order; a step that isn't fatal may fail and is reported."""
    done = []
    for name, step, fatal in steps:
        try:
            step()
            done.append((name, "ok"))
        except Exception as error:
            if fatal:
                raise
            done.append((name, f"failed: {type(error).__name__}"))
    return done


class RunMetrics(StreamingQueryListener):
    """Every batch's figures, one file a (query, batch) under root, written by the listener as batches end.

    A query keeps its id over restarts, and a batch that is run again doesn't
    write over its first figures, so nothing is counted twice or forgotten,
    however many batches there are. Figures are the batch's input rows and
    what the query observes under a name (DataFrame.observe).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._ended: dict[str, threading.Event] = {}

    def _event(self, run: object) -> threading.Event:
        return self._ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._event(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {f"{name}.{k}": v for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        figures = {"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "observed": {k: str(v) for k, v in seen.items()}}
        self.files.put_new(f"{self.root}/query={p.id}/{p.batchId:010d}.json", json.dumps(figures))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._event(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all of an ended query's batches were heard of."""
        if not self._event(query.runId).wait(seconds):
            raise TimeoutError("the query's end wasn't heard of")

    def batches(self) -> DataFrame:
        """(query, batch, rows, observed) of all batches so far."""
        return self.spark.read.schema("query string, batch bigint, rows bigint, observed map<string,string>").json(f"{self.root}/query=*")
