"""Registered queries of the corpus operators, over whole tables, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.class_lm import perplexity_scores
from tidemark.llm.common import documents, labels
from tidemark.llm.conversation_repair import repair_sql, repaired_conversations
from tidemark.llm.cover_tree import near_vectors, near_vectors_sql
from tidemark.llm.document_fingerprints import fingerprints
from tidemark.llm.language_id import identify
from tidemark.llm.mixing import mix, mix_sql
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack, sequence_costs
from tidemark.llm.quality_rules import quality, quality_sql
from tidemark.llm.spelling import spelling_sql, spelling_variants, vocabulary
from tidemark.llm.substring_dedup import dedup_units, dedup_units_sql
from tidemark.llm.token_counts import section_tokens, with_token_lengths
from tidemark.llm.toxicity import toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).rows


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_units(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.array_join(F.transform("_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    chars = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select("doc_id", F.col("_n_repeated").alias("n_repeated"), F.col("_n_removed").alias("n_removed"), chars.alias("removed_chars"), spans.alias("spans"), F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in tokens of the byte-pair vocabulary and one end a text; a sequence costs a fixed part and attention too."""
    counted = with_token_lengths(documents(spark, sf_dir).select("doc_id", "text"))
    return pack(counted, length=F.col("n_tokens") + 1, costs=sequence_costs())


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_scores(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(documents(spark, sf_dir), misprint=199))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_source_mixing, op3_language_id, op4_document_fingerprints, op5_token_counts, op6_minhash_near_dedup, op7_toxicity, op8_substring_dedup, op9_best_fit_packing, op10_class_lm, op11_spelling_variants, op12_embedding_near_dedup, op13_conversation_repair)}

#: DuckDB SQL of the same rows. Components of near duplicates: all pairs with a shingle in common, then reachability.
NEAR_SQL = r"""
with recursive texts as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sets as materialized (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end as s from texts),
each as materialized (select doc_id, unnest(s) as h from sets),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from each a join each b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as materialized (select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.b) as component_id, s.doc_id = min(r.b) as kept from sets s join reach r on r.a = s.doc_id group by s.doc_id, len(s.s)"""

ORACLES = {
    "op1_quality_rules": quality_sql(),
    "op2_source_mixing": mix_sql(),
    "op6_minhash_near_dedup": NEAR_SQL,
    "op8_substring_dedup": dedup_units_sql(),
    "op11_spelling_variants": spelling_sql(),
    "op12_embedding_near_dedup": near_vectors_sql(),
    "op13_conversation_repair": repair_sql(),
}
