"""A training corpus from the documents table, in five stages.

quality: the weak-label classifier is trained on the documents; those it rejects go.
near_duplicates: one document of each SimHash group stays (3-word shingles, 2 bits).
personal_data: what patterns and model find in a text is replaced by its kind.
mix: documents are repeated or left out until each source has its share of the words.
packing: token sequences of 1024, one row per piece, with its ids.

Each function takes (spark, docs, sf_dir). ``run`` writes each stage's rows once, as a
driver of the stages would, so that no stage repeats the work of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlfold.llm import common, mixing, packing, pii, quality, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, stats = quality.train(docs, "doc_id", "text")
    common.unstage(stats)
    return quality.keep_clean(docs, "text", model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, "doc_id", "text", shingle=3, radius=2)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, "doc_id", "text", length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, "doc_id", "text", "source", weights=(3, 1, 2), share=1.5, cap=2.0, carry=docs.columns)
    copies = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(*[F.col(f"`carry_{c}`").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, "doc_id", "text", capacity=1024)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, model scores and token ids are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common.session(docs)
    given = docs
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not given:
            common.unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
