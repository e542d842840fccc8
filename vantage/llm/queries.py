"""The registered queries of the corpus operators: each applies its operator with
production parameters to the whole of its table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import (
    chat,
    decontamination,
    extraction,
    license_scan,
    mixing,
    near_duplicates,
    ngram_join,
    personal_data,
    quality_classifier,
    quality_rules,
    sharding,
    sql,
    tokenizer_alignment,
    vector_codes,
)
from vantage.llm.common import read_table, stash


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(read_table(spark, sf_dir, "pages"))


def op3_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    out = quality_classifier.score_documents(docs, model, carry=["doc_id"])
    return out.select(
        "doc_id",
        quality_classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op4_typed_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    messages = rows.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_conversations(messages).withColumn("turns", chat.read_turns(F.col("formatted")))
    out = out.withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "attachment_tokens",
    )


def op5_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim, per_source = mixing.plan(read_table(spark, sf_dir, "documents"))
    mixed = mixing.copies(slim, per_source)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source"
    )


def op6_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.withColumn("notices", F.to_json("notices"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.screen_documents(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"
    )


def op8_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(read_table(spark, sf_dir, "documents")).drop("tkey")


def op9_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data.find_personal_data(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *(number(k) for k in personal_data.BASE_KINDS),
        F.sha2(personal_data.span_list(F.col("base")), 256).alias("base_sha256"),
        personal_data.span_list(F.col("spans")).alias("spans"),
    )


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    recs = stash(sharding.records(docs).drop("text"))
    placed = sharding.place(recs, sharding.build_map(sharding.slot_loads(recs), n_shards=8))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "map_version",
    )


TOKENIZERS = "/opt/tokenizers"


def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return tokenizer_alignment.aligned_statistics(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op12_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read_table(spark, sf_dir, "documents"))


def op13_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return out.select(
        "vec_id",
        F.array_join(F.transform("code", lambda k: F.lpad(F.lower(F.hex(k)), 2, "0")), "").alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fm_index_decontamination": op1_fm_index_decontamination,
        "op6_fuzzy_notices": op6_fuzzy_notices,
        "op2_site_style_tree": op2_site_style_tree,
        "op3_neighbour_vote": op3_neighbour_vote,
        "op4_typed_chat_parts": op4_typed_chat_parts,
        "op5_hash_threshold_mix": op5_hash_threshold_mix,
        "op7_robust_outliers": op7_robust_outliers,
        "op8_multi_index_hamming": op8_multi_index_hamming,
        "op9_crf_personal_data": op9_crf_personal_data,
        "op10_virtual_slots": op10_virtual_slots,
        "op11_merge_path_alignment": op11_merge_path_alignment,
        "op12_size_aware_join": op12_size_aware_join,
        "op13_gnat_codes": op13_gnat_codes,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
