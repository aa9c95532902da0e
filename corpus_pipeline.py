"""The corpus pipeline: language ID, near-duplicates, decontamination, PII masking and packing over documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents,
whatever columns there are beside doc_id, text and lang. Stages other than near_duplicates judge repeated rows one by one.
Texts of any length are read whole; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, language, neardup, packing, pii
from quire.plans.scratch import Scratch

#: Ids of dropped duplicates up to which their list is broadcast (16 bytes each); beyond that, the join shuffles.
BROADCAST_IDS = 1_000_000
#: A language is accepted with at least this posterior probability.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts that are null or have no letter go."""
    model = language.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = language.identify(docs, model, lang_out="_quire_lang", score_out="_quire_score")
    return found.where((F.col("_quire_lang") != language.UNDETERMINED) & (F.col("_quire_score") >= LEAST_SCORE)).drop("_quire_lang", "_quire_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    Rows are judged one by one, also where several share a doc_id: texts that nothing duplicates stay, and of repeats of a
    row one stays. Rows without a doc_id, and texts without words, stay.
    """
    scratch, text_key = Scratch(spark, "pipeline"), F.xxhash64("text")
    rows = docs.select("doc_id", "text", text_key.alias("text_key"))
    found = scratch.table(neardup.near_duplicates(rows, keep=["text_key"], group_out="group").select("doc_id", "text_key", "group", "kept"), "found")
    kept = found.where("kept and group is not null")
    twice = scratch.table(kept.groupBy("doc_id", "group").agg(F.count("*").alias("n"), F.min("text_key").alias("best")).where("n > 1").drop("n"), "twice")
    others = kept.join(twice, ["doc_id", "group"]).where("text_key <> best")
    gone = scratch.table(found.where("not kept").select("doc_id", "text_key").unionByName(others.select("doc_id", "text_key")).distinct(), "gone")
    on = [docs["doc_id"] == F.col("quire.doc_id"), text_key == F.col("quire.text_key")]

    def listed(ids: DataFrame) -> DataFrame:
        return (F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids).alias("quire")

    left = docs.join(listed(gone), on, "left_anti")
    if twice.isEmpty():
        return left
    once = listed(twice.select("doc_id", F.col("best").alias("text_key")).distinct())
    return left.join(once, on, "left_anti").unionByName(left.join(once, on, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(docs, items, hits_col="_quire_hits").where(F.size("_quire_hits") == 0).drop("_quire_hits")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, such as <EMAIL>; n_chars follows where there is one. Null texts stay null."""
    found = pii.detect(docs, pii.train(docs), base_out="_quire_base", spans_out="_quire_spans")
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col("_quire_spans")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
