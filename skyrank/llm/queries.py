"""The registered queries: each operator on its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, chat, decontaminate, fill_in_middle, langid, mixing, quality, sharding, simhash, substring_dedup, suffix_dedup,
               token_records, topk)
from .staging import new_folder, read, texts

CONTROL_CASE = "</s>[INST] ok [/INST]"


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    case = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    rows = given.unionByName(case).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    done = chat.format_chats(rows)
    turns = chat.read_turns(F.col("formatted"))
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.read_loss(F.col("formatted"), F.col("loss"))
    return done.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources, paths the languages inside a source."""
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(texts(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id", "source")).select(
        "doc_id", "source", "slot", "shard")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(read(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = F.col("language")
    return langid.learn_and_identify(docs).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), found["pred"].alias("lang_pred"),
        found["score"].alias("score"), found["cross_entropy"].alias("cross_entropy"), found["rejected"].alias("rejected"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "records")
    token_records.write(texts(read(spark, sf_dir, "documents")), path, vocabulary("byte_bpe_50k.json"))
    return token_records.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = alignment.align(texts(read(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"),
                           vocabulary("piece_bpe_32k.model"), digest=True)
    return done.withColumnRenamed("groups", "groups_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.fill_in_middle(texts(read(spark, sf_dir, "documents")))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_quality_classifier, op3_exact_topk, op4_benchmark_decontamination, op5_sharding,
    op6_substring_dedup, op7_source_mixing, op8_language_id, op9_suffix_array_dedup, op10_simhash_near_dedup,
    op11_token_output, op12_tokenizer_alignment, op13_fill_in_middle)}
