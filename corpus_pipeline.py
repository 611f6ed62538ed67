"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs. All but the last return the columns of documents; the last returns where each remaining document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import decontam, neardup, packing, pseudonyms, queries, tokens, toxicity
from skyloom.llm.scratch import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicate stage: five-word shingles, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score stays below the threshold; learned from the labelled ones outside the held-out quarter.

    Rows of null or empty texts get the base rate and stay where it is below the threshold. Repeated rows stay or go together, a null id stays
    null, and without labels every row stays. Columns that documents don't have are left out.
    """
    marked = queries.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~queries.held_out())
    model = toxicity.learn(docs, marked)
    return toxicity.score_toxicity(docs.select(*COLUMNS, F.col("text").alias("_scored")), model, text="_scored").where("predicted = 0").select(*COLUMNS)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of an id, or of none, and a text hash (doc_id, text_hash) that stand in gone."""
    rows = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(rows["_id"]) & (F.xxhash64(docs["text"]) == rows["_hash"])
    return docs.join(rows, same, "left_anti").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id. Repeated rows leave one."""
    return without(docs, neardup.near_duplicates(docs, size=SHINGLE, percent=PERCENT).where("not kept")).dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included; only the texts that hold one go, whatever their ids."""
    return without(docs, decontam.contaminated(docs, queries.table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms of the same form under the session's secret key; n_chars follows the new text."""
    masked = pseudonyms.pseudonymise(docs.select(*COLUMNS), counts=None)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, batch, place and padding of every document."""
    counted = tokens.count_tokens(docs.select("doc_id", "text"), queries.vocabulary())
    return packing.pack(counted.select("doc_id", "n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack_batches),
]

#: SQL can't express the learned score, the vocabulary's counts or the packing's program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
