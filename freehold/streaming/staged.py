"""What was staged before, forever, without reading it all: hashed buckets with a Bloom filter for each bucket and folder.

A batch's hashes are first asked of the filters of their own buckets. Only
bucket files whose filter may hold one of them are read, and those exactly: a
filter never denies what is there, so a content is staged once, and a batch of
new contents reads filters alone. Filters are bitmaps made by Spark's bitmap
functions: PROBES bits a hash among ``bits`` of its bucket, in pieces of 32,768,
of which only those with a set bit are stored. A folder is what one batch added;
small folders are merged into larger ones as they come (each at most a few
times), so a bucket has few files. Versions make a batch one step, done once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshots import GRACE_SECONDS, Versions
from ..sources.work import kept

PROBES = 4
#: Folders from which the newest are merged.
MERGE_AFTER = 8


class StagedContents:
    """Rows by record_hash under root. bits: about ten times the rows that a bucket of a folder may come to have."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "record_hash", buckets: int = 64, bits: int = 1 << 20, merge_after: int = MERGE_AFTER):
        self.spark, self.schema, self.key, self.buckets, self.bits, self.merge_after = spark, schema, key, buckets, bits, merge_after
        self.versions = Versions(spark, root)
        #: Bucket files that the last batch had to read.
        self.last_read: list[str] = []

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _bits(self) -> Column:
        """The bits of a hash in its bucket's filter, from 1 on."""
        return F.array(*[F.pmod(F.xxhash64(F.concat(F.lit(f"{k}:"), F.col(self.key))), F.lit(self.bits)) + 1 for k in range(PROBES)])

    def read(self, manifest: dict | None = None) -> DataFrame:
        folders = (self.versions.current()[1] if manifest is None else manifest).get("folders", [])
        paths = [f"{f['path']}/rows/bucket={b}" for f in folders for b in f["buckets"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> dict:
        """A folder of rows by bucket with its filters."""
        path = self.versions.new_folder()
        spread = rows.select(*self.schema.names, self._bucket()).repartition("bucket")
        spread.write.partitionBy("bucket").parquet(f"{path}/rows")
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/rows")
        bit = written.select("bucket", F.explode(self._bits()).alias("bit"))
        filters = bit.groupBy("bucket", F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
        filters.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/filters")
        return {"path": path, "rows": written.count(), "buckets": [int(n.split("=")[1]) for n in self.versions.files.names(f"{path}/rows") if "=" in n]}

    def candidates(self, hashes: DataFrame, manifest: dict) -> list[str]:
        """Bucket files that may hold one of the hashes, by the filters of the hashes' buckets."""
        wanted = {r[0] for r in hashes.select(self._bucket()).distinct().collect()}
        filters = None
        for k, folder in enumerate(manifest.get("folders", [])):
            paths = [f"{folder['path']}/filters/bucket={b}" for b in folder["buckets"] if b in wanted]
            if paths:
                one = self.spark.read.option("basePath", f"{folder['path']}/filters").schema("piece bigint, bitmap binary, bucket int").parquet(*paths).withColumn("folder", F.lit(k))
                filters = one if filters is None else filters.unionByName(one)
        if filters is None:
            return []
        asked = hashes.select(self.key, self._bucket(), F.explode(self._bits()).alias("bit")).select(self.key, "bucket", F.bitmap_bucket_number("bit").alias("piece"), F.bitmap_bit_position("bit").alias("at"))
        byte = F.conv(F.hex(F.expr("substring(bitmap, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
        is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0
        hits = asked.join(filters, ["bucket", "piece"]).where(is_set).groupBy("folder", "bucket", self.key).agg(F.count("*").alias("n"))
        found = hits.where(F.col("n") == PROBES).select("folder", "bucket").distinct().collect()  # one a bucket file
        return sorted(f"{manifest['folders'][r['folder']]['path']}/rows/bucket={r['bucket']}" for r in found)

    def stage(self, batch: DataFrame, batch_id: int, stream: str = "stage") -> int:
        """Adds rows whose content isn't staged yet, once each; how many. A batch that was done adds nothing."""
        rows = kept(batch.select(self.schema.names).dropDuplicates([self.key]), "batch")
        added = 0

        def step(now: dict) -> dict | None:
            nonlocal added
            added, self.last_read = 0, []
            if batch_id <= now.get("batches", {}).get(stream, -1):
                return None
            self.last_read = self.candidates(rows, now)
            new = rows
            if self.last_read:
                there = self.spark.read.schema(self.schema).parquet(*self.last_read).select(self.key)
                new = rows.join(there, self.key, "left_anti")
            folder = self._write(new)
            added = folder["rows"]
            return {"folders": [*now.get("folders", []), *([folder] if added else [])], "batches": now.get("batches", {}) | {stream: batch_id}}

        self.versions.publish(step)
        self.merge()
        return added

    def merge(self) -> bool:
        """Puts the newest folders, as many as are not much larger than those after them, into one when there are many."""
        now = self.versions.current()[1]
        folders = now.get("folders", [])
        if len(folders) <= self.merge_after:
            return False
        first, rows = len(folders) - 1, folders[-1]["rows"]
        while first and (folders[first - 1]["rows"] <= 2 * rows or first >= self.merge_after):
            first -= 1
            rows += folders[first]["rows"]
        old = folders[first:]
        one = self._write(self.read({"folders": old}))

        def step(current: dict) -> dict | None:
            at = [f["path"] for f in current["folders"]]
            if any(f["path"] not in at for f in old):
                return None  # another merge came first
            kept_ = [f for f in current["folders"] if f["path"] not in {x["path"] for x in old}]
            return {**current, "folders": [*kept_[: at.index(old[0]["path"])], one, *kept_[at.index(old[0]["path"]) :]]}

        self.versions.publish(step)
        return True

    def vacuum(self, grace: float = GRACE_SECONDS) -> list[str]:
        return self.versions.vacuum(lambda m: [f["path"] for f in m.get("folders", [])], grace)
