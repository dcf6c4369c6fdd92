"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), calls one operator of ``tidemark.llm`` on all that its predecessor
kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack, sequence_costs
from tidemark.llm.quality_rules import quality
from tidemark.llm.substring_dedup import dedup_units
from tidemark.llm.token_counts import with_token_lengths
from tidemark.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Slots of 20,000 characters whose documents are packed together: about a million tokens.
WINDOW_SLOTS = 300
PLACE = ("_file", "_row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. The verdict is part of the scan: nothing is joined or moved."""
    return quality(docs, carry=COLUMNS, only_kept=True).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that near_duplicates keeps, each by its id and text, so that rows with one id or none are judged each for itself.

    Only of rows whose id and shingle set are both equal one stays: the least by text key, then by text, lang, source and n_chars.
    """
    kept = near_duplicates(docs, keys=True).where("kept").groupBy(F.col("doc_id").alias("_kept"), "class_id").agg(F.min("text_key").alias("_key")).select("_kept", "_key")
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    rows = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_key")))
    least = rows.groupBy("doc_id", "_text").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("_row"))
    return least.select("doc_id", "_row.*").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus; n_chars follows the text. Texts left without a word go."""
    cut = dedup_units(docs.select(*COLUMNS))
    changed = F.size("_spans") > 0
    return cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars"))


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, written in the order of its slot in the mix, so that sources stand at their target weights all along.

    A source that runs out leaves the schedule and the others go on in their own proportions; documents without a slot come last.
    """
    tied = docs.withColumns({"_digest": _digest(), "_of": F.coalesce("source", F.lit(""))})
    # Ties of a slot follow the order of the mix: documents of one source stand in the order in which its blocks were cut.
    in_mix = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_digest")).cast("binary"))
    slots = mix(tied, carry=("_digest",)).rows.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("_digest").alias("_t")).agg(F.min("slot").alias("_slot"))
    placed = tied.join(slots, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_s")) & (F.col("_digest") == F.col("_t"))).withColumn("_order", in_mix)
    order = [F.col("_slot").asc_nulls_last(), F.col("_of"), F.col("_order"), F.col("doc_id")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def standing(docs: DataFrame) -> DataFrame:
    """Documents with their place: file and row of stored ones, partition and row of others."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.select("*", F.lit("").alias("_file"), F.monotonically_increasing_id().alias("_row"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece of a document; bins hold documents of neighbouring slots and carry their window.

    Slots are those of the order in which the documents stand (file and row), which is that of the mix: a
    source's documents fill its blocks one after another. Lengths are tokens of the byte-pair vocabulary and one end a
    text, and a sequence costs a fixed part and its attention too.
    """
    sized = standing(docs).select("doc_id", "source", "text", F.length(F.coalesce("text", F.lit(""))).alias("_chars"), _digest().alias("_digest"), *PLACE)
    counted = with_token_lengths(sized, out="_tokens", keep=False)
    rows = mix(counted, carry=("_tokens", "_digest"), size="_chars", place=PLACE).rows
    # pack() reads texts only for a fixed order; the digest serves for that.
    return pack(rows.withColumnRenamed("_digest", "text"), length=F.col("_tokens") + 1, costs=sequence_costs(), window=F.expr(f"slot div {WINDOW_SLOTS}"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Greedy packing has no reasonable SQL form; the tests hold the other stages against SQL or a plain version, packing against a plain one, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
