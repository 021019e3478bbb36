"""What several operators of this package need: scratch tables, id picks and components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that pick_ids() may broadcast at most (8 bytes each); larger sets are joined by a shuffle.
BROADCAST_IDS = 2_000_000

#: A key of more rows than this is looked up by broadcast in connected_components() instead of meeting in one task.
HOT_KEY = 1_000_000

WORD = "[^\\x20\\x09-\\x0D]+"


class Scratch:
    """Parquet tables in the shared folder that the session names in spark.checkpoint.dir.

    A saved table cuts the lineage and outlives any executor. save() also lets
    the session's cleaner see that earlier shuffles are done with, and drop()
    removes a table that is no longer read, so a long job's disk use stays level.
    """

    def __init__(self, spark: SparkSession):
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if root is None:
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
            if not held.isDefined():
                if not spark.sparkContext.master.startswith("local"):
                    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
                spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
                held = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = held.get()
        self.spark = spark
        self.root = f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return back

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick_ids(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """rows whose ``column`` is (or, left_anti, isn't) in ids; broadcast only below a counted bound."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, column, how)


def _with_least(rows: DataFrame, hot: int) -> DataFrame:
    """(u, v, m): rows (u, v) with the least v of their u.

    A u of more than HOT_KEY rows is looked up by broadcast, so its rows stay in
    the tasks that read them: there are at most rows / HOT_KEY such keys (hot
    says how many, at most). The rest are joined by a shuffle.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    if not hot:
        return rows.join(least.select("u", "m"), "u")
    often = least.where(F.col("c") > HOT_KEY).select("u", F.col("m").alias("m_often"))
    marked = rows.join(F.broadcast(often) if hot <= BROADCAST_IDS else often, "u", "left")
    rare = marked.where("m_often is null").select("u", "v").join(least.where(F.col("c") <= HOT_KEY).select("u", "m"), "u")
    return marked.where("m_often is not null").select("u", "v", F.col("m_often").alias("m")).unionByName(rare.select("u", "v", "m"))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the undirected edges; label is the component's least node.

    Alternating large-star and small-star steps: a step links each node's
    larger (then smaller) neighbours to its least neighbour, so the graph turns
    into one star per component within a logarithmic number of rounds. Every
    step is an aggregation with map-side combine and a join in which a hub's
    edges stay spread over tasks. It ends when no node has two lesser
    neighbours, or a lesser and a greater one: then each component is a star
    around its least node. Self loops, nulls and repeated edges are ignored;
    no edges give no rows.
    """
    pair = lambda u, v: [F.col(u).alias("u"), F.col(v).alias("v")]
    now = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )

    def state(t: DataFrame) -> tuple[int, int]:
        """(nodes that keep t from being stars, nodes of more than HOT_KEY edges)."""
        ends = t.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(t.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        return tuple(per.agg(F.count_if(F.expr("up > 1 or (up > 0 and down > 0)")), F.count_if(F.col("up") + F.col("down") > HOT_KEY)).first())

    loose, hot = state(now)
    while loose:
        both = now.unionByName(now.select(*pair("v", "u")))
        large = _with_least(both, hot).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = scratch.save(large, "large")
        small = (
            _with_least(large, hot)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        small = scratch.save(small, "small")
        scratch.drop(now, large)
        now = small
        loose, hot = state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
