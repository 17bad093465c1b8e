"""The named queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.llm import (
    backoff, bpe, chat, cotrain, exact, middle, phrases, pii, prefixes, rules, setsketch, suffixes, warc,
)


#: Longest n-gram that op3_backoff counts: a word is scored by up to four words of history.
BACKOFF_ORDER = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read_back = chat.examples(rows.union(extra)).select(
        "conv_id", "target", chat.loss_text().alias("loss"),
        F.length("text").cast("bigint").alias("chars"),
        F.when(F.col("complete"), chat.turns(F.col("text"))).alias("turns"),
    )
    turn_text = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    replies = F.array_sort(F.collect_list(
        F.when(F.col("target").isNotNull(), F.struct("target", "loss"))
    ))
    return read_back.withColumn("turn_text", turn_text).groupBy("conv_id").agg(
        F.max(F.size("turns")).cast("bigint").alias("n_turns"),
        F.max(F.sha2(F.array_join("turn_text", "").cast("binary"), 256)).alias("turns_sha256"),
        F.sum(F.length("loss")).cast("bigint").alias("loss_chars"),
        F.sha2(F.array_join(replies["loss"], "").cast("binary"), 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
    )


def op3_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"), order=BACKOFF_ORDER)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    header = F.col("header")
    payload = F.col("payload").cast("binary")
    digest = F.substring(warc.header_value(header, "WARC-Payload-Digest"), 6, 32)
    length = warc.header_value(header, "Content-Length").cast("bigint")
    kind = warc.header_value(header, "WARC-Type")
    block = F.octet_length("record") - F.octet_length("header") - 4
    sound = (digest == warc.base32_sha1(payload)) & (length == block)
    read_back = records.select(
        "page_id", F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.when(sound, digest).otherwise(
            F.raise_error(F.lit("a record disagrees with its headers"))
        ).alias("payload_digest"),
        kind.alias("record_type"),
        warc.header_value(header, "WARC-Record-ID").alias("record_id"),
        warc.header_value(header, "WARC-Refers-To").alias("refers_to_id"),
    )
    named = read_back.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    return read_back.join(named, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{kind}" for kind in pii.BASE_KINDS],
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans",
        "n_url", "n_account",
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = phrases.build(table(spark, sf_dir, "documents"))
    found = phrases.search(segments, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id", "n_words", phrases.covered().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.label(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior",
    )


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefixes.trie(prefixes.rebuilt(turns))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.examples(table(spark, sf_dir, "documents"))
    text = middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(spark, f"{sf_dir}/documents.parquet")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_chat": op2_chat,
    "op3_backoff": op3_backoff,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_setsketch": op7_setsketch,
    "op8_decontaminate": op8_decontaminate,
    "op9_cotraining": op9_cotraining,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefixes": op11_prefixes,
    "op12_middle": op12_middle,
    "op13_exact": op13_exact,
}
