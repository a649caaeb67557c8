"""The registered queries of this subpackage: thin calls of its operators on their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import _common as C
from tidewright.llm import license_scan


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import toxicity

    docs = C.read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, C.read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", C.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import jaccard_join

    return jaccard_join.join(C.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import mixing

    return mixing.mix(C.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import packing

    return packing.pack(C.read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).drop("ids")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import exact_dedup

    marks = exact_dedup.dedup(C.read(spark, sf_dir, "documents"), exact_dedup.half("doc_id"))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import language_id

    docs = C.read(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import media

    folder = C.scratch_path(spark, "media")
    catalogue = C.as_table(media.store(C.read(spark, sf_dir, "documents"), folder), "catalogue")
    found = media.features(media.fill_metadata(media.objects(catalogue), folder), folder)
    found = C.as_table(found, "features").drop("shard", "offset", "length", "bits")
    joined = catalogue.select("doc_id", "digest").join(found, "digest")
    return joined.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.concat_ws(" ", "sentences").alias("sentences"), F.concat_ws(",", "licenses").alias("licenses"), "n_unknown")


#: The rules of op8.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import url_filter

    pages = C.read(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, URL_RULES, url_filter.fit(pages, URL_RULES))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm import token_counts

    return token_counts.count_tokens(C.read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_source_mix": op3_source_mix,
    "op4_packing": op4_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_media_columns": op6_media_columns,
    "op7_license_scan": op7_license_scan,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op7_license_scan": license_scan.oracle_sql(),
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept
              FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r
    """,
}
