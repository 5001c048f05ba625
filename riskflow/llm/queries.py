"""One query per operator of this package over its whole table, and the SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import (
    bpe,
    decontam,
    hilbert,
    hpylm,
    html_crf,
    lexical,
    ngram_join,
    quality,
    repair,
    suffix,
    toxicity,
    url_filter,
    warc,
)
from riskflow.llm.common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded", remembered=500_000).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", *quality.NAMES, "base_failed", "kept"
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontam.search(docs, items).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.cut(read(spark, sf_dir, "documents").select("doc_id", "text"), 400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    entries = F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat_ws("=", e.key, e.value)))
    return warc.resolve(warc.records_of_pages(pages)).select(
        "record_id", "canonical_url", "response_id", "outcome",
        F.when(F.col("merged").isNotNull(), F.array_join(entries, ";")).alias("merged"),
        "response_digest",
    )


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    indexed = hilbert.with_index(narrow, ["source", "lang", "size"], bits=5).drop("lang", "source")
    return hilbert.shard(indexed, 24, "hilbert", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: rules of the URL query: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).drop("url")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(read(spark, sf_dir, "conversations"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.judge(docs.select("doc_id", "text"), labels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_hpylm": op2_hpylm,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffix": op5_suffix,
    "op6_main_text": op6_main_text,
    "op7_revisits": op7_revisits,
    "op8_hilbert": op8_hilbert,
    "op9_ngram_join": op9_ngram_join,
    "op10_urls": op10_urls,
    "op11_repair": op11_repair,
    "op12_lexical": op12_lexical,
    "op13_toxicity": op13_toxicity,
}

SQL: dict[str, str] = {
    "op4_decontaminate": decontam.SQL, "op7_revisits": warc.SQL, "op9_ngram_join": ngram_join.SQL,
    "op12_lexical": lexical.SQL,
}
