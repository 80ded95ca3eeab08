"""Registered queries of the training-data operators and their SQL.

Each applies its operator to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armspan.llm import pu_quality, sql, toxic_crf
from armspan.llm.common import pick
from armspan.llm.contextual_pii import find_personal_data
from armspan.llm.histogram_shards import shard_by_bytes
from armspan.llm.norm_buckets import top_products
from armspan.llm.page_archive import describe_records, read_records, write_archive
from armspan.llm.pivot_codes import compress
from armspan.llm.sequence_files import read_documents, write_sequences
from armspan.llm.simhash_trie import near_duplicates
from armspan.llm.simplex_clusters import cluster
from armspan.llm.source_schedule import mixed_sizes
from armspan.llm.string_tiling import leaks
from armspan.llm.token_counts import count_tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = pick(documents(spark, sf_dir), "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_by_bytes(rows, "doc_id", "size", shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(vectors, F.col("vec_id") % 50 == 0)


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op6_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trained = toxic_crf.trained_fold(F.col("doc_id"))
    model = toxic_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), trained)
    return toxic_crf.toxicity(docs, model).select("doc_id", *_decided(trained), "spans")


def op7_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(documents(spark, sf_dir))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trained = pu_quality.trained_fold(F.col("doc_id"))
    model = pu_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), trained)
    return pu_quality.quality(docs, model).select("doc_id", *_decided(trained))


def _decided(trained: Column, threshold: float = 0.3) -> list[Column]:
    held_out = F.coalesce(~trained, F.lit(False)).alias("held_out")
    return [held_out, F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted")]


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_sequences(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(files)


def op11_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = describe_records(read_records(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_top_products": op3_top_products,
    "op4_string_tiling": op4_string_tiling,
    "op5_contextual_pii": op5_contextual_pii,
    "op6_toxic_crf": op6_toxic_crf,
    "op7_source_schedule": op7_source_schedule,
    "op8_pu_quality": op8_pu_quality,
    "op9_simhash_trie": op9_simhash_trie,
    "op10_sequence_files": op10_sequence_files,
    "op11_content_archive": op11_content_archive,
    "op12_simplex_clusters": op12_simplex_clusters,
    "op13_pivot_codes": op13_pivot_codes,
}

ORACLES = {
    "op3_top_products": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where embedding is not null
              and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        ),
        pairs as (
            select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
            from v q join v c on q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0
        )
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank,
            vec_id, score
        from pairs
        qualify rank <= 5
    """,
    "op11_content_archive": sql.ARCHIVE,
    "op12_simplex_clusters": sql.clusters(),
    "op13_pivot_codes": sql.codes(),
}
