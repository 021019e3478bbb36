"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

A document's key is -ln(u)/w, with u a hash of its id and w its quality weight;
documents of a source are taken in the order of their keys until the source's
word budget is met, so better documents are likelier to be among them. A target
of several times the source's size first takes every document whole that many
times (complete epochs) and samples only the remaining fraction.

Defined results
- Null text or no words: size 0, nothing is taken. Null source: a source of its own, ordered last.
- Null id: keyed as the id "". Repeated rows (id and size) are taken alike.
- The document at the budget's edge is taken in part, so a source's words meet its target to a word; repeated
  rows there share what is left evenly, and leave less than a word each.
- Empty table: no rows. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Steps of a key's natural logarithm by which a source's words are summed; whatever the weights, a step holds at most 1 / (e FINE) of a source's documents of one weight.
#: A source has some tens of times FINE steps at most, which one task adds up, and the documents of one step are sorted by one task.
FINE = 512
_WORD_RUN = "[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+"
_ODD = "[^0-9#*$%&|<>!=_{}~^]++"


def n_words(text: Column) -> Column:
    """Number of words; null or blank: 0. Every word with the white space around it becomes one letter."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, _WORD_RUN, "x"), "[^x]++", "")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: falls with the share of a text's characters that are symbols or digits."""
    odd = F.length(F.regexp_replace(text, _ODD, ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - odd * 2.0 / F.nullif(F.length(text), F.lit(0))), F.lit(0.05))


def uniform(id_: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f"#{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) a source.

    Weights repeat over the sources in code point order, null last. A share
    above cap times the source's size is cut to it and the excess is dealt
    again by weight. That is one water level: sources are sorted by the level
    that fills them, and the first that the level of the rest doesn't fill ends
    the cutting. Only one row a source goes through these windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("fill", F.col("cap") / F.col("w"))
        .withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("left_w"))
    )
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"]
    return t.withColumn("level", level).select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
) -> DataFrame:
    """(row, mix): each row of docs as a struct, and what the mix takes of it.

    mix holds size, source_size, target, epochs, part and taken: the words
    taken of the row are size * epochs, and of the fractional epoch the ``part``
    that its place in its source's key order leaves. Words are summed by small
    steps of the key first; only the documents of the step in which a source's
    budget ends are sorted, to find the one at its edge. Every other row is then
    told by its key alone, so no text is shuffled and no task sorts a source.
    """
    scratch = Scratch(docs.sparkSession)
    text, ident, source = (docs[c] for c in (text_col, id_col, source_col))
    size, w = n_words(text), quality_weight(text) if quality is None else quality
    key = F.coalesce(-F.log(uniform(ident, seed)) / w, F.lit(0.0))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), source.alias("source"), F.coalesce(ident.cast("string"), F.lit("")).alias("ident"), size.alias("size"), key.alias("key"))
    step = F.coalesce(F.floor(F.log("key") * FINE), F.lit(-(1 << 40))).cast("long")
    slim = scratch.save(rows.select("source", "ident", "size", "key", step.alias("step")), "sizes")
    steps = scratch.save(slim.groupBy("source", "step").agg(F.sum("size").alias("words")), "steps")

    groups = steps.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(groups, weights, cap)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long")
    targets = scratch.save(targets.withColumn("epochs", epochs).withColumn("budget", budget).withColumnRenamed("source", "s"), "targets")

    on_source = F.col("source").eqNullSafe(F.col("s"))
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # sums, not documents
    reached = steps.withColumn("upto", F.sum("words").over(upto)).join(targets.select("s", "budget"), on_source).where(F.col("upto") >= F.col("budget"))
    edges = reached.groupBy("s", "budget").agg(F.min(F.struct("step", (F.col("upto") - F.col("words")).alias("start"))).alias("e")).select("s", "budget", F.col("e.step").alias("at"), "e.start")
    near = slim.join(edges, on_source & (F.col("step") == F.col("at"))).groupBy("s", "budget", "start", "key", "ident", "size").agg(F.count("*").alias("n"))
    within = Window.partitionBy("s").orderBy("key", "ident", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("start") + F.sum(F.col("size") * F.col("n")).over(within)).where(F.col("upto") >= F.col("budget"))
    share = F.floor((F.col("budget") - (F.col("upto") - F.col("size") * F.col("n"))) / F.col("n")).cast("long")
    edge = near.groupBy("s").agg(F.min(F.struct("key", "ident", "size", share.alias("share"))).alias("e")).select("s", F.struct("e.key", "e.ident", "e.size").alias("edge"), F.col("e.share").alias("share"))
    plan = targets.join(edge.withColumnRenamed("s", "s1"), F.col("s").eqNullSafe(F.col("s1"))).select("s", "source_size", "target", "epochs", "edge", "share")
    plan = scratch.save(plan, "plan")  # one row a source
    scratch.drop(slim, steps, targets)

    place = F.struct("key", "ident", "size")
    part = F.when(place < F.col("edge"), F.col("size")).when(place == F.col("edge"), F.col("share")).otherwise(F.lit(0)).cast("long")
    return (
        rows.join(plan, on_source)
        .withColumn("part", part)
        .select("row", F.struct("size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")).alias("mix"))
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: a row for each complete epoch, then the part of the fractional one.

    A part that isn't the whole text is its first words. Columns are those of docs.
    """
    out = mix(docs, **options)
    text_col = options.get("text_col", "text")
    copies = F.concat(F.array_repeat(F.lit(True), F.col("mix.epochs").cast("int")), F.array_repeat(F.lit(False), (F.col("mix.part") > 0).cast("int")))
    words = F.split(F.regexp_replace(F.col(f"row.{text_col}"), "^[\\x20\\x09-\\x0D]++", ""), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    head = F.array_join(F.slice(words, 1, F.greatest(F.col("mix.part"), F.lit(1)).cast("int")), "")
    text = F.when(F.col("whole") | (F.col("mix.part") == F.col("mix.size")), F.col(f"row.{text_col}")).otherwise(head)
    return out.select("row", "mix", F.explode(copies).alias("whole")).select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs.select("doc_id", "source", "text"))
    return out.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(greatest(0.05, 1.0 - length(regexp_replace(text, '[^0-9#*$%&|<>!=_{}~^]+', '', 'g')) * 2.0 / nullif(length(text), 0)), 0.05)::DOUBLE AS w,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#7'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key, sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / w, doc_id::VARCHAR NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / w AS fill FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level <= fill ORDER BY fill LIMIT 1))::DOUBLE AS target FROM l),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t)
SELECT k.doc_id, k.size, e.source_size, e.target,
       (e.epochs * k.size + least(k.size, greatest(0, floor(e.target - e.epochs * e.source_size + 0.5)::BIGINT - k.before)))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
