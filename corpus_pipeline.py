"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  The first four
return the columns of documents; the last returns packed pieces.  ``run`` writes
every stage to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm import decontam, near_dedup, packing, queries, secrets, toxicity
from graftline.operators.stash import stash
from graftline.operators.unions import union_all

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression rejects go.

    Null and empty texts stay; repeated rows stay or go together; other columns than
    those of documents are dropped here and in every stage.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs.select(COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest id, once.

    Documents without words are in no group and stay.  Rows without an id, or that
    share one, are documents by their texts: equal rows are one, and others are kept
    or dropped each by itself, under a hash of id and text (2^62 or more) in place of the id.
    """
    shared = stash(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1 and doc_id is not null").select("doc_id"), "shared")
    by_text = F.xxhash64(F.col("doc_id"), F.col("text")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    marked = docs.select(COLUMNS).join(shared.withColumn("_shared", F.lit(True)), "doc_id", "left")
    keyed = marked.withColumn("_key", F.when(F.col("_shared") | F.col("doc_id").isNull(), by_text).otherwise(F.col("doc_id"))).drop("_shared")
    found = near_dedup.near_duplicates(keyed, near_dedup.NearDedup(width=5), id_col="_key")
    # Only keys that go, or that several rows with words share, are joined with the texts.
    flags = found.groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("_gone"), F.count_if(F.col("n_shingles") > 0).alias("_rows")).filter("_gone or _rows > 1").withColumnRenamed("doc_id", "_key")
    seen = keyed.join(stash(flags, "flags"), "_key", "left")
    once = seen.filter("_gone is null").select(COLUMNS)
    return union_all([once, seen.filter("not _gone").dropDuplicates(["_key"]).select(COLUMNS)])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text, or a window of it, go.

    Null and empty texts stay, and match nothing; repeated rows stay or go together.
    """
    return decontam.without_leaks(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret spans are replaced in the text; every document stays.

    n_chars is the new text's length.  A null text stays null, and so is its length.
    """
    found = secrets.scan(docs.select(COLUMNS), queries.secret_model(spark, sf_dir), redacted_col="redacted")
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2048; null and empty texts are one end id."""
    return packing.pack(docs, queries.BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
