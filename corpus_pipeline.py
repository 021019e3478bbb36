"""From raw documents to token counts: quality, near duplicates, repeated passages, source mix, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet in the session's shared checkpoint folder and reads again as
the next stage's docs. All but the last return the columns of documents.

Defined results
- Null ids stay rows of their own in every stage. Null, empty or blank texts get the model's score of an empty text in
  the first stage, link with nothing in the second, pass the third as they are, and end in the fourth, which takes no words of them.
- Repeated rows: the second stage keeps one of those that agree in id and text (the least by the other columns), so every
  different text of an id that is kept stays.
- Empty tables give no rows in every stage. Extra columns pass through to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freehold.llm import additive, bpe, chaining, jaccard, mixing
from freehold.llm.shared import Scratch, pick_ids

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model predicts to be of quality 1; labels teach it, never decide."""
    model = additive.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return additive.score_quality(docs, model, keep=docs.columns).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component of linked texts; of rows that repeat an id and text, one."""
    found = jaccard.near_duplicate_components(docs).where("component_id = doc_id or n_shingles = 0").select("doc_id").distinct()
    found = Scratch(spark).save(found, "kept")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = Scratch(spark).save(repeated, "repeated")
    kept = pick_ids(docs, found, "doc_id")
    once = pick_ids(kept, repeated, "doc_id", "left_anti")
    again = pick_ids(kept, repeated, "doc_id").groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")).select("_row.*")
    parts = [x.select(docs.columns) for x in (once, again, docs.where("doc_id is null"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a lesser id has."""
    return _counted(chaining.drop_repeated_passages(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, the last of a source cut to its budget."""
    return _counted(mixing.mixed_rows(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed texts, and of their decoding."""
    out = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "source"), with_ids=False)
    return out.select("row.doc_id", "row.source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: No SQL: the learnt model, the components and the chains have none. Tests hold stages against brute force and on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(before)
    return docs
