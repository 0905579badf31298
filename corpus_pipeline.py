"""From raw documents to token ids: five stages, each on all that the one before kept.

Quality rules drop documents, near duplicates leave one document of each group,
documents with benchmark passages go, personal data is replaced in the texts,
and what remains is encoded. All stages but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import bpe, decontaminate, minhash_dedup, pii, quality_rules
from lectern.llm._stages import Stages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8; the smallest id of a group stays.

    Of rows that repeat an id and a text one stays. Documents without an id have
    no place in that order, so they stay.
    """
    kept = minhash_dedup.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    own = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__id"), "left_semi")
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), F.length("text")).orderBy(F.lit(0)))
    return own.withColumn("__copy", copy).where("__copy = 1").drop("__copy").unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark_contaminated(docs, benchmark, out_col="__matches").where(F.size("__matches") == 0).drop("__matches")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in angle brackets; n_chars follows the text."""
    plain = [f"__own{k}" for k in range(len(docs.columns))]
    found = pii.find_personal_data(docs.toDF(*plain), plain[docs.columns.index("text")])
    size = F.char_length("redacted").cast("long")
    new = {"text": F.col("redacted"), "n_chars": size}
    cols = [F.when(F.col(p).isNotNull(), new[c]).alias(p) if c in new else F.col(p) for p, c in zip(plain, docs.columns, strict=True)]
    return found.select(*cols).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids and the digests of ids and decoded text."""
    return bpe.encode(docs, bpe.word_bpe(), keep=["doc_id"])


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("decontaminate", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

ORACLE_SQL = None  # near duplicates, similar windows and tokens have no SQL form; tests/llm/test_pipeline.py has the brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = Stages(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written.save(stage(spark, docs, sf_dir), name)
        if before:
            written.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
