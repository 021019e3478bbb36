"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of distinct 5-word shingles have Jaccard
similarity of at least 80 %. Equal sets are one node. In any fixed order of the
shingles, two linked nodes share at least min(l, l') shingles of their
prefixes, where a node of n shingles and level l has the prefix of the first
n - ceil(0.8 n) + l.

1. Sieve. In hash order with a level of a tenth of the set, a node whose prefix
   holds fewer shared shingles than any partner would need has no partner. Most
   documents end here, and only prefixes were shuffled.
2. Order. The remaining nodes' whole sets are counted; shingles are ordered by
   frequency, rare first. Shingles of one node only match nothing and are left
   out, so a prefix keeps only what other nodes hold too.
3. Level. Each node lengthens its prefix to the level with the least estimated
   cost: postings to scan, plus verifications of at most postings / level nodes.
4. Hubs. Each node is verified against the head of another component that it
   meets most often in its posting lists. Lists that hold one component only are
   done with; the rest vote again until few components still merge. So a large
   group of near copies is joined by about one link a node, hub or no hub.
5. Rest. Posting lists that still hold several components are bundled by their
   main component; every pair across components that shares enough prefix
   shingles is verified in blocks of bounded size. Pairs inside a component need
   no test, and a block gives a link only where it joins two components, so at
   most one fewer than it has components.

Defined results
- Null or blank text: 0 shingles, linked with nothing. Fewer than five words: one shingle of all of them.
- Null doc_id: the row takes no part; its component is null. Repeated rows share an id, hence a component.
- Empty table: no rows. Shingles and sets are told apart by 64-bit hashes (a set also by its size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, connected_components, pick_ids
from .wordnum import mix64, shingle_sets, slices

WIDTH = 5
PERCENT = 80
LEVELS = (1, 2, 3, 4, 6, 8)
#: A block of the last step holds about so many nodes, or so many shingles if that is fewer nodes.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 2_000_000
#: Hubs are voted on again while a round's links are at least this share of the nodes left; what remains is for the blocks, whatever its size.
AGAIN = 0.01


def _rest(n: Column) -> Column:
    """ceil(0.8 n): what a node of n shingles must share with any partner."""
    return F.ceil(n * F.lit(PERCENT) / F.lit(100.0)).cast("int")


def _sieve_level(n):
    """A tenth of the set, at least one."""
    return np.maximum(1, -(-n // 10))


def _set_hash(s: np.ndarray) -> int:
    return int(mix64(np.array([np.bitwise_xor.reduce(mix64(s + np.uint64(len(s)))) if len(s) else 0], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, prefixes: bool) -> DataFrame:
    """(doc_id, n, node) of each row of (doc_id, text); with prefixes also the hash-order prefix for the sieve."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sieve", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), WIDTH)
                n = np.array([len(s) for s in sets], np.int64)
                take = np.minimum(n, n - -(-n * PERCENT // 100) + _sieve_level(n)) * int(prefixes)
                cuts = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                flat = np.concatenate([s[:k] for s, k in zip(sets, take, strict=True)]).view(np.int64) if cuts[-1] else np.zeros(0, np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array([_set_hash(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))], [f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, t) of each row of (doc_id, text): one row a shingle."""
    fields = [T.StructField("node", T.LongType()), T.StructField("t", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), WIDTH)
                n = [len(s) for s in sets]
                if sum(n):
                    yield pa.record_batch([pa.array(np.repeat([_set_hash(s) for s in sets], n)), pa.array(np.concatenate(sets).view(np.int64))], [f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def choose_level(n: int, df: np.ndarray) -> tuple[int, int]:
    """(level, shared shingles in its prefix) of least estimated cost for a node of n shingles.

    df holds the frequencies of the node's shared shingles, rare first. A level's
    cost is its prefix's postings, and at most postings / level verifications.
    """
    least = -(-n * PERCENT // 100)
    mass = np.concatenate([[0], np.cumsum(df - 1)])
    best = (np.inf, 1, 0)
    for level in LEVELS:
        if level > max(1, least):
            break
        k = int(min(len(df), max(0, n - least + level - (n - len(df)))))  # shingles that no other node has come first and match nothing
        best = min(best, (mass[k] * (1 + min(n, 512) / (16 * level)), level, k))
    return best[1:]


def with_prefixes(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, n, level, pre, all): from (node, t, df) the shared shingles of each node of sizes.

    ``pre`` are those in the node's own prefix, ``all`` the whole of them sorted
    by value. A prefix without any can meet no other node, so such nodes go.
    """
    per_node = shared.groupBy("node").agg(F.collect_list(F.struct("df", "t")).alias("s")).join(sizes, "node").select("node", "n", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("s")
            cuts, flat_s = lists.offsets.to_numpy(), lists.values
            df, t = flat_s.field("df").to_numpy(), flat_s.field("t").to_numpy()
            rows, levels, pres, alls = [], [], [], []
            for i, n in enumerate(batch.column("n").to_pylist()):
                mine = slice(cuts[i], cuts[i + 1])
                values, first = np.unique(t[mine], return_index=True)
                f = df[mine][first]
                order = np.lexsort((values, f))
                level, k = choose_level(n, f[order])
                if k:
                    rows.append(i)
                    levels.append(level)
                    pres.append(values[order[:k]])
                    alls.append(values)
            if rows:
                at = pa.array(rows)
                listed = lambda arrays: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)), pa.array(np.concatenate(arrays)))
                yield pa.record_batch([batch.column("node").take(at), batch.column("n").take(at), pa.array(levels, pa.int32()), listed(pres), listed(alls)], ["node", "n", "level", "pre", "all"])

    return per_node.mapInArrow(run, "node long, n long, level int, pre array<long>, all array<long>")


def _linked(n_a, n_b, common):
    return 100 * common >= PERCENT * (n_a + n_b - common)


def verify_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, n_a, n_b, all_a, all_b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c) for c in ("all_a", "all_b")]
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            common = np.array([len(np.intersect1d(values[0][i].values.to_numpy(), values[1][i].values.to_numpy(), assume_unique=True)) for i in range(batch.num_rows)], np.int64)
            keep = pa.array(_linked(n_a, n_b, common), pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _verify_block(block: pd.DataFrame) -> pd.DataFrame:
    """Pairs of components that links between the foreign and the other nodes of one block join; a forest, so fewer than there are components."""
    members, foreign = block[~block["query"]], block[block["query"]]
    joins: list[tuple[int, int]] = []
    if len(members) and len(foreign):
        sides = {}
        for name in ("pre", "all"):
            lists = [np.asarray(x, np.int64) for x in members[name]]
            sizes = np.array([len(x) for x in lists])
            words, codes = np.unique(np.concatenate(lists), return_inverse=True)
            sides[name] = (words, codes, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        n, level, root = (members[c].to_numpy().copy() for c in ("n", "level", "comp"))
        became: dict[int, int] = {}

        def shared(name: str, values) -> np.ndarray:
            words, codes, starts = sides[name]
            flags = np.zeros(len(words) + 1, np.int32)
            at = np.searchsorted(words, values)
            at[at == len(words)] = 0
            flags[at[words[at] == values]] = 1
            return np.add.reduceat(flags[codes], starts)

        for q in foreign.itertuples(index=False):
            mine = int(q.comp)
            while mine in became:
                mine = became[mine]
            may = (root != mine) & (100 * np.minimum(n, q.n) >= PERCENT * np.maximum(n, q.n))
            if may.any():
                may &= shared("pre", np.asarray(q.pre, np.int64)) >= np.minimum(level, q.level)
            if may.any():
                common = shared("all", np.asarray(q.all, np.int64))
                for other in np.unique(root[may & _linked(n, q.n, common)]).tolist():
                    joins.append((mine, other))
                    became[other] = mine
                    root[root == other] = mine
    return pd.DataFrame(joins, columns=["a", "b"]).astype("int64")


def _verified(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of chosen whose two nodes link."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("all").alias(f"all_{s}"))
    return verify_pairs(chosen.join(side("a"), "a").join(side("b"), "b"))


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows (..., comp) with comp replaced by what connected_components() made of it."""
    moves = moves.select(F.col("node").alias("comp"), "label")
    return rows.join(moves, "comp", "left").withColumn("comp", F.coalesce("label", "comp")).drop("label")


def link_components(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of the nodes (node, n, level, pre, all): comp is the same for nodes that links connect.

    placed holds the posting lists with each node's component so far. Links
    between components become links of their labels, so a component is one
    vertex however many nodes it has.
    """
    at = nodes.select("node", F.col("node").alias("comp"))
    placed = nodes.select("node", F.col("node").alias("comp"), "n", F.explode("pre").alias("t"))

    def merge(pairs: DataFrame) -> None:
        nonlocal at, placed
        moves = scratch.save(connected_components(pairs, scratch), "moves")
        at, placed = scratch.save(_moved(at, moves), "at"), _moved(placed, moves)

    while True:  # 4
        ends = placed.groupBy("t").agg(F.min(F.struct("comp", "node", "n")).alias("lo"), F.max(F.struct("comp", "node", "n")).alias("hi")).where("lo.comp < hi.comp")
        live = scratch.save(placed.join(ends, "t"), "live")
        placed = live.select("node", "comp", "n", "t")
        head = F.when(F.col("comp") != F.col("lo.comp"), F.col("lo")).otherwise(F.col("hi"))
        votes = live.select("node", "comp", "n", head.alias("h")).where(100 * F.least("n", "h.n") >= PERCENT * F.greatest("n", "h.n"))
        votes = votes.groupBy("node", "comp", F.col("h.node").alias("head"), F.col("h.comp").alias("of")).agg(F.count("*").alias("votes"))
        chosen = votes.groupBy("node", "comp").agg(F.max(F.struct("votes", "head", "of")).alias("h"))
        chosen = scratch.save(chosen.select(F.col("node").alias("a"), F.col("h.head").alias("b"), "comp", F.col("h.of").alias("of")), "chosen")
        links = _verified(chosen.select("a", "b"), nodes)
        links = scratch.save(links.join(chosen, ["a", "b"]).select(F.col("comp").alias("a"), F.col("of").alias("b")), "links")
        n = links.count()
        if n:
            merge(links)
        if n <= AGAIN * chosen.count():
            break

    # 5
    mixed = placed.groupBy("t", "comp").agg(F.count("*").alias("c")).groupBy("t").agg(F.max(F.struct("c", "comp"))["comp"].alias("bundle"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    members = scratch.save(placed.join(mixed, "t").select("bundle", "node", "comp").distinct(), "members")
    members = members.join(nodes.select("node", F.size("all").alias("k")), "node")
    foreign = F.col("comp") != F.col("bundle")
    parts = lambda c, k: F.greatest(F.lit(1), F.ceil(c / BLOCK_NODES), F.ceil(k / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("bundle").agg(
        parts(F.count("*"), F.sum("k")).alias("m_parts"), parts(F.count_if(foreign), F.sum(F.when(foreign, F.col("k")).otherwise(0))).alias("q_parts")
    )
    dealt = members.join(sizes, "bundle")
    part = lambda of: F.pmod(F.xxhash64("node"), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    as_member = dealt.select("bundle", "node", "comp", F.lit(False).alias("query"), part(F.col("m_parts")).alias("i"), every("q_parts").alias("j"))
    as_query = dealt.where(foreign).select("bundle", "node", "comp", F.lit(True).alias("query"), every("m_parts").alias("i"), part(F.col("q_parts")).alias("j"))
    blocks = as_member.unionByName(as_query).join(nodes, "node")
    merge(blocks.groupBy("bundle", "i", "j").applyInPandas(_verify_block, "a long, b long"))
    return at


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row a row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    known = docs.where("doc_id is not null")

    # 1: a list counts as shared when it holds two different nodes, however many copies of one
    signed = scratch.save(signatures(known, True), "signed")
    posts = signed.where("n > 0").select("doc_id", "node", F.explode("sieve").alias("t"))
    lists = scratch.save(posts.groupBy("t").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("t"), "lists")
    need = F.greatest(F.lit(1), F.ceil(_rest(F.col("n")) / F.lit(10.0)))  # the level of the smallest partner
    hits = posts.select("doc_id", "t").join(lists, "t").groupBy("doc_id").agg(F.count("*").alias("hits"))  # of all rows of a repeated id: too many at worst, which keeps more
    hits = hits.join(signed.where("n > 0").select("doc_id", "node", "n"), "doc_id").where(F.col("hits") >= need)
    alive = scratch.save(hits.groupBy("node", "n").agg(F.min("doc_id").alias("doc_id")), "alive")
    wide, signed = signed, scratch.save(signed.select("doc_id", "n", "node"), "ids")
    scratch.drop(wide, lists)  # the sieve's prefixes are the largest table

    # 2 and 3: a repeated id may count a shingle twice, which changes the order for all nodes alike
    sets = full_sets(pick_ids(known, alive.select("doc_id"), "doc_id").select("doc_id", "text"))
    counts = scratch.save(sets.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    nodes = scratch.save(with_prefixes(sets.join(counts, "t"), alive.select("node", "n")), "nodes")
    scratch.drop(counts)

    groups = link_components(nodes, scratch).withColumnRenamed("comp", "label")

    classes = signed.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("first"))
    in_group = classes.join(groups, "node")
    firsts = in_group.groupBy("label").agg(F.min("first").alias("component_id"))
    joined = in_group.join(firsts, "label").select("node", "n", "component_id")
    classes = classes.join(joined, ["node", "n"], "left").select("node", "n", F.coalesce("component_id", "first").alias("component_id"))
    out = signed.select("doc_id", "n", "node").join(classes.withColumnRenamed("n", "m").withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & (F.col("n") == F.col("m")), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = signatures(docs.where("doc_id is null"), False).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("component_id"))
    return out.unionByName(nameless)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: For tables of distinct ids.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS k
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, k, i, w, lead(w, 1) OVER o AS a, lead(w, 2) OVER o AS b, lead(w, 3) OVER o AS c, lead(w, 4) OVER o AS d FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, md5(concat_ws(' ', w, a, b, c, d)) AS t FROM g WHERE d IS NOT NULL OR (k < 5 AND i = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
