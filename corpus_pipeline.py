"""Documents to packed training sequences, in four stages: toxicity, MinHash near-duplicates, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads them for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.llm import minhash, packing, passages, toxicity
from voxmeter.llm.common import join_small, materialize
from voxmeter.llm.registry import held_out, table
from voxmeter.sources.session import shared_dir

#: Near-duplicates have five-word shingles and this similarity (percent) at least.
NEAR_PERCENT = 80


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. It is fitted on labelled documents that are not held out.

    Rows that share a null or repeated doc_id are rejected one by one, by their own texts; null and empty texts stay.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    # The row itself rides along as the scored row's id, so no join is needed.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("scored"))
    kept = toxicity.score(rows, model, id_col="row", text_col="scored").where(F.col("score") < toxicity.REJECT)
    return kept.select(*[F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates; rows of a null doc_id all stay."""
    found = minhash.near_duplicates(docs, percent=NEAR_PERCENT)
    gone = materialize(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return join_small(docs, gone, "doc_id", "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller doc_id has too; n_chars is that of the text that is left.

    No document goes: one that consists of such passages stays with what is left, an empty text or white space.
    """
    found = passages.passages(docs)
    if "n_chars" not in docs.columns:
        return passages.remove(docs, found)
    # The text as it was rides along under a name that no column has.
    before = "before"
    while before in {c.lower() for c in docs.columns}:
        before += "_"
    left = passages.remove(docs.withColumn(before, F.col("text")), found)
    changed = ~F.col("text").eqNullSafe(F.col(before))
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, each with its token ids."""
    return packing.pack(docs)


STAGES = [("toxicity", keep_clean), ("near_duplicates", keep_one_of_each_group), ("passages", cut_repeated_passages), ("packing", pack)]

#: SQL can express neither the model's scores nor the chained passages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
