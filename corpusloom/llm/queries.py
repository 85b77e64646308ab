"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language_id, mixing, near_duplicates, packing, secrets, sharding, tiff, topk, url_filters
from .common import table

#: The production tokenizer, a parameter of the packing operator.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~language_id.held_out()).select("doc_id", "lang", "text"))
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, positions=True).select("doc_id", "source", "epoch", "mix_tokens", "mix_weight", "mix_block", "mix_order")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.rule_table(spark, URL_RULES)).drop("url")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, 2048, 0)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link_components(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).drop("text")
    base = [r.kind for r in secrets.BASE]
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.filter("secret_spans", lambda x: x["kind"].isin(base))
    counts = [_count(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")


def op10_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = tiff.text_to_tiff(docs)
    media = files.withColumns({"media_bytes": F.octet_length("content").cast("long"), "media_sha256": F.sha2("content", 256)})
    pages = tiff.tiff_pages(media)  # a document is one page, so that its pixels are its payload
    size = F.octet_length("pixels").cast("long")
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), F.array_join(F.col("histogram").cast("array<string>"), ","))
    return pages.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_mixing": op2_mixing,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_sharding": op4_sharding,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_url_filters": op6_url_filters,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_secret_scans": op9_secret_scans,
        "op10_media_tiff": op10_media_tiff,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL
