"""The operators as registered queries over the given tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.llm import bpe, html, language, minhash, packing, quality, repair, substring, suffix, topk, trie, url_filter, vectors
from gaitworks.llm import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return enter


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_url_filter", S.URL_FILTER)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(
        "SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), "
        "('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, verdict)"
    )
    judged = url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


@query("op3_html_main_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.cut(packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests)


@query("op5_byte_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids"), ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_substring_dedup", S.SUBSTRING_DEDUP)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = substring.remove_repeated(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_minhash_near_dedup", S.NEAR_DEDUP)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_exact_top_k", S.TOP_K)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 100 == 0, 10)


@query("op9_embedding_near_dedup", S.VECTOR_DEDUP)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return vectors.near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept")


@query("op10_suffix_array_dedup", S.SUFFIX_DEDUP)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = suffix.remove_repeated(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_prefix_trie", S.PREFIX_TRIE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


@query("op12_conversation_repair", S.CONVERSATION_REPAIR)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


@query("op13_quality_classifier")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    scored = quality.classify(docs, model)
    return scored.select("doc_id", language.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
