"""A training corpus from raw documents, one operator per stage.

Stages take ``(spark, docs, sf_dir)`` and return what they keep; ``run`` writes each stage to the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.llm import langid, mixing, packing, secret_scan, simhash, toxicity
from convolens.llm.common import free_name, kept, read_in_order, table

# Toxicity is learnt and secrets are found by models that SQL cannot express.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic; labels of the training folds teach the score.

    Columns of any name pass through; null and empty texts stay, as do ids without a label.
    """
    train = ~langid.held_out(F.col("doc_id"), 3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(train)
    model = toxicity.fit(docs.where(train), labels, corpus=docs)
    name = free_name("_toxic", docs)
    scored = docs.withColumn(name, toxicity.score_column(spark, model, F.col("text")))
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each SimHash group.

    Rows equal in id and text are one document; of rows that share an id but not the text, those
    stay whose group has no smaller id. Documents without an id belong to no group and stay. Columns
    of any name pass through.
    """
    body = free_name("_body", docs)
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(body, F.xxhash64("text"))
    groups = simhash.near_duplicates(named.select("doc_id", "text", body), row=body)
    first = groups.where("doc_id = component_id").select("doc_id", F.col("row").alias(body)).distinct()
    alone = named.join(first, ["doc_id", body], "left_semi").dropDuplicates(["doc_id", body])
    return alone.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; no document goes."""
    clean = secret_scan.redact(docs, secret_scan.dictionary(docs.select("doc_id", "text")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source as often as its target says, in training order; repeats are rows."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mixed documents, packed, in the order of training.

    Packing decides what shares a sequence; ``sequence_order`` numbers the sequences by the mean
    position of their tokens in the mix, which is the order its files were written in. Documents that
    are no written table have a null ``position``.
    """
    name = free_name("_position", docs)
    placed = read_in_order(docs.select("doc_id", "text"), name)
    pieces = kept(packing.tokenized(placed, position=F.col(name)), "pieces")
    return packing.in_training_order(kept(packing.pack(pieces), "packed"))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_dedup", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
