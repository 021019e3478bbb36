"""Keyed tables whose changes are written as they come: base files, and small delta files on top of them.

Rows belong to buckets, a few values that follow from a row's key (the year of
its date, a hash of it). A change reads only the buckets that it has rows for,
and writes only the rows that differ; a reader puts bases and deltas together.
A bucket with many deltas is written anew as one base, and no other is touched.
Versions (snapshots.py) make each change one step: readers see all of it or
nothing, and a stream's batch that was committed before is not done again.

Two ways to put layers together: ``last`` (of the rows of a key the one of the
latest change) and ``sum`` (keys with signed counts n, which are added up; rows
whose sum is nought are gone).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshots import GRACE_SECONDS, Versions
from .work import drop_kept, kept, tidy

#: Rows of a batch up to which its keys may be sent to the stored rows; those of more meet them in one join.
FEW_ROWS = 100_000
#: Rows of the buckets that an upsert takes at once, as far as one has no more.
PASS_ROWS = 600_000
#: Deltas of a bucket from which it is written anew.
COMPACT_AFTER = 8
_NULL = "none"


def null_safe(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in key])


def _passes(counts: dict[str, int]) -> list[list[str]]:
    """Buckets in groups of at most PASS_ROWS rows, or one."""
    out, rows = [], 0
    for b, n in sorted(counts.items()):
        if out and rows + n <= PASS_ROWS:
            out[-1].append(b)
            rows += n
        else:
            out.append([b])
            rows = n
    return out


class Layers:
    """A table at root with the given key; bucket says how a row's bucket follows from its key columns."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str], bucket: Column, how: str = "last", compact_after: int = COMPACT_AFTER):
        if how not in ("last", "sum"):
            raise ValueError("how must be last or sum")
        self.spark, self.schema, self.key, self.how, self.compact_after = spark, schema, list(key), how, compact_after
        self.bucket = F.coalesce(bucket.cast("string"), F.lit(_NULL))
        self.versions = Versions(spark, root)

    # ---- reading

    def read(self, buckets: Iterable[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows, of all buckets or the given ones, of the current version or of a manifest's."""
        held = (self.versions.current()[1] if manifest is None else manifest).get("buckets", {})
        wanted = held if buckets is None else {b: held[b] for b in buckets if b in held}
        plain = [layers["base"] for layers in wanted.values() if layers["base"] and not layers["deltas"]]
        layered = {b: layers for b, layers in wanted.items() if layers["deltas"]}
        out = self._files(plain)
        if layered:
            below = [layers["base"] for layers in layered.values() if layers["base"]]
            by_change: dict[int, list[str]] = {}
            for layers in layered.values():
                for change, path in layers["deltas"]:
                    by_change.setdefault(change, []).append(path)
            out = out.unionByName(self._merged(self._files(below), by_change))
        return out

    def _files(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _merged(self, base: DataFrame, by_change: dict[int, list[str]]) -> DataFrame:
        if self.how == "sum":
            both = reduce(DataFrame.unionByName, [base, *(self._files(p) for p in by_change.values())])
            return both.groupBy(*self.key).agg(F.sum("n").alias("n")).where("n <> 0").select(self.schema.names)
        deltas = reduce(DataFrame.unionByName, [self._files(p).withColumn("_change", F.lit(change)) for change, p in by_change.items()])
        rows = F.struct("_change", *self.schema.names)
        latest = deltas.groupBy(*self.key).agg(F.max_by(rows, "_change").alias("_row")).select("_row.*").drop("_change")
        # only keys of the deltas meet the base, which stays where it is when they are few enough to be sent to it
        return base.join(latest.select(self.key), null_safe(base, latest, self.key), "left_anti").unionByName(latest)

    # ---- writing

    def buckets_of(self, rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in rows.select(self.bucket.alias("b")).distinct().collect())

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows by bucket; bucket -> path of those that got any."""
        folder = self.versions.new_folder()
        rows.select(*self.schema.names, self.bucket.alias("_bucket")).repartition("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(16))).write.partitionBy("_bucket").parquet(folder)
        tidy(self.spark)
        return self._written(folder)

    def _written(self, folder: str) -> dict[str, str]:
        """bucket -> path below a folder."""
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in self.versions.files.names(folder) if n.startswith("_bucket=")}

    def change(self, make: Callable[[dict], DataFrame | dict[str, str] | None], stream: str | None = None, batch: int | None = None, note: Callable[[], str | None] = lambda: None) -> list[str]:
        """One step: make(manifest) gives the rows to lay on top, or the paths of those it wrote by bucket; the buckets that got some.

        With stream and batch: a batch up to the last one that the stream
        committed is not done again; note() is remembered with it.
        """
        got: dict[str, str] = {}

        def step(now: dict) -> dict | None:
            got.clear()
            if stream is not None and batch is not None and batch <= now.get("batches", {}).get(stream, [-1])[0]:
                return None
            rows = make(now)
            got.update(self._write(rows) if isinstance(rows, DataFrame) else rows or {})
            number = now.get("changes", 0) + 1
            held = {b: {"base": x["base"], "deltas": list(x["deltas"])} for b, x in now.get("buckets", {}).items()}
            for b, path in got.items():
                held.setdefault(b, {"base": None, "deltas": []})["deltas"].append([number, path])
            batches = now.get("batches", {}) | ({stream: [batch, note()]} if stream is not None else {})
            return {"buckets": held, "changes": number, "batches": batches}

        self.versions.publish(step)
        for b in got:
            self.compact(b)
        return sorted(got)

    def upsert(self, rows: DataFrame, update: Sequence[str], stream: str | None = None, batch: int | None = None) -> DataFrame | None:
        """Lays on top what a guarded upsert inserts or updates (one row a key).

        Gives the changed rows with ``action`` and ``was``, the row before as a
        struct (null for an insert). The last batch of a stream gives the same
        again when it is replayed, and changes nothing; an older one gives None.
        What is given is what was laid on top, so it is written once, and a large
        batch a few buckets at a time.
        """
        from ..operators.upsert import guarded_upsert

        made: list[str] = []

        def make(now: dict) -> dict[str, str]:
            incoming = kept(rows, "incoming")  # made once
            made.append(self.versions.new_folder())
            counts = dict(map(tuple, incoming.groupBy(self.bucket.alias("b")).count().collect()))  # a row a bucket
            for group in _passes(counts):
                some = incoming.where(self.bucket.isin(group)) if len(group) < len(counts) else incoming
                held = [b for b in group if b in now.get("buckets", {})]
                if held:
                    stored = self.read(held, now)
                    if sum(counts[b] for b in group) <= FEW_ROWS:
                        keys = some.select(self.key)
                        stored = stored.join(F.broadcast(keys), null_safe(stored, keys, self.key), "left_semi")
                    out = guarded_upsert(stored, some, self.key, update, was=True).where("action <> 'keep'")
                else:
                    given = [F.col(f.name) if f.name in some.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
                    out = some.select(*given, F.lit("insert").alias("action"), F.lit(None).cast(self.schema).alias("was"))
                out.withColumn("_bucket", self.bucket).write.mode("append").partitionBy("_bucket").parquet(made[-1])
                tidy(self.spark)
            drop_kept(incoming)
            return self._written(made[-1])

        self.change(make, stream, batch, lambda: made[-1])
        if not made and stream is not None:
            last, folder = self.versions.current()[1]["batches"][stream]
            made += [folder] if last == batch and folder else []
        changed = T.StructType([*self.schema.fields, T.StructField("action", T.StringType()), T.StructField("was", self.schema)])
        return self.spark.read.schema(changed).parquet(made[-1]).drop("_bucket") if made else None

    def replace(self, make: Callable[[dict], DataFrame], buckets: Iterable[str]) -> None:
        """The given buckets, and those that the rows of make(manifest) belong to, become these rows; no other is touched."""
        wanted = set(buckets)

        def step(now: dict) -> dict:
            got = self._write(make(now))
            held = {b: x for b, x in now.get("buckets", {}).items() if b not in wanted}
            return {**now, "buckets": held | {b: {"base": path, "deltas": []} for b, path in got.items()}}

        self.versions.publish(step)

    def compact(self, bucket: str, always: bool = False) -> bool:
        """Writes a bucket of many deltas anew as one base; a change that comes first wins, and this is tried again later."""
        number, now = self.versions.current()
        layers = now.get("buckets", {}).get(bucket)
        if not layers or not layers["deltas"] or not (always or len(layers["deltas"]) > self.compact_after):
            return False
        paths = self._write(self.read([bucket], now))

        def step(current: dict) -> dict | None:
            if current["buckets"].get(bucket) != layers:
                return None
            return {**current, "buckets": {**current["buckets"], bucket: {"base": paths.get(bucket), "deltas": []}}}

        self.versions.publish(step)
        return True

    def vacuum(self, grace: float = GRACE_SECONDS) -> list[str]:
        """Removes folders that only versions replaced more than grace seconds ago name."""

        def folders(m: dict) -> list[str]:
            layers = [p for x in m.get("buckets", {}).values() for p in [x["base"], *(d[1] for d in x["deltas"])] if p]
            return [p.rsplit("/", 1)[0] for p in layers] + [note for _, note in m.get("batches", {}).values() if note]

        return self.versions.vacuum(folders, grace)
