"""The registered queries of this subpackage: thin, each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, htmltext, language, licenses, negatives, packing, pieces, pii, quality, repair, tokencount
from quire.llm.neardup import near_duplicates
from quire.llm.oracles import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_items, item_ids (comma-joined, in order), containment (the largest), contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("hits", lambda x: x["item_id"]))
    return found.select(
        "doc_id", F.size("hits").cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"),
        F.array_max(F.transform("hits", lambda x: x["containment"])).alias("containment"), (F.size("hits") > 0).alias("contaminated"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "select cast(-1 as bigint) conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (cast(0 as bigint), 'user'), (1, 'assistant') as t(turn, role)"
    made = chat.render(turns.unionByName(spark.sql(planted)))
    read = made.select("conv_id", "formatted", "valid", chat.read_back(F.col("formatted"), chat.INST).alias("turns"))
    learnt = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, licenses (license:start:end:coverage in thousandths, comma-joined by start)."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.floor(x["coverage"] * 1000).cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(told, ",").alias("licenses"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.train(docs))
    told = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",") for c in ("base_spans", "spans")}
    kinds = F.transform("base_spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(told["base_spans"], 256).alias("base_sha256"), told["spans"].alias("spans"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = htmltext.extract(pages, htmltext.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = repair.damaged(whole)
    found = repair.audited(rows, whole)
    hashes = repair.digests(repair.repaired(rows, found)).select(F.col("conv_id").alias("id"), "sha256")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.join(hashes, found.conv_id.eqNullSafe(hashes.id), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", nothing).alias("repaired_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = table(spark, sf_dir, "embeddings"), F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    vector = F.when(~odd, F.transform(x, lambda v: F.floor(256 * v.cast("double"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 100 == 0)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_chat_format, op3_packing, op4_license_scan, op5_quality_rules, op6_personal_data, op7_html_text, op8_language_id, op9_near_duplicates, op10_token_counts,
        op11_conversation_repair, op12_hard_negatives, op13_sentencepiece,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
