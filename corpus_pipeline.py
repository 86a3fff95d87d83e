"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
No stage reads the result of another one except through ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlake.llm import langid, mixing, near_dedup, packing, quality_rules
from meterlake.llm.scratch import Scratch
from meterlake.llm.words import held_out

#: Score under which a language is a guess; the winner of four has 0.25 at least.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null, no letters, or no language ahead of the others."""
    fits = langid.identify(docs, docs.where(~held_out("doc_id", 4, 2)))
    return fits.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def keyed(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``key``, a long of its own for each row that stays the same in whatever splits the table is read.

    That is doc_id where each row has one and none repeats. Else the rows are stored once more with numbers, which
    costs a copy of the texts.
    """
    own = docs.withColumn(key, F.col("doc_id").try_cast("bigint"))
    unfit = own.groupBy(key).agg(F.count("*").alias("rows_of_key")).where(F.col(key).isNull() | (F.col("rows_of_key") > 1))
    if not unfit.limit(1).count():
        return own
    return Scratch(spark, "keyed").keep(docs.withColumn(key, F.monotonically_increasing_id()), "docs")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of the least id, of none only where no row of the group has
    one; rows that share an id, or have none, are compared by their texts like any others."""
    key = "stage_key"
    while key in docs.columns:
        key += "_"
    rows = keyed(spark, docs, key)
    found = near_dedup.near_duplicates(rows, doc_id=key).select(F.col("doc_id").alias("stage_row"), "component_id")
    ids = rows.select(F.col(key).alias("stage_own"), F.col("doc_id").alias("stage_id"))
    first = F.min(F.struct(F.col("stage_id").isNull(), "stage_id", "stage_own")).alias("row")
    least = found.join(ids, F.col("stage_row") == F.col("stage_own")).groupBy("component_id").agg(first)
    kept = Scratch(spark, "kept").keep(least.select(F.col("row.stage_own").alias(key)), "keys")
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's words: whole documents, repeated for further epochs, and one cut at each source's budget."""
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("doc_id", F.col("text").alias("stage_text"), F.struct(*own).alias("stage_rest"), F.col("source"))
    mixed = mixing.mix(named, text="stage_text", carry=("stage_text", "stage_rest")).where("taken > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    # words with the space before them, up to the last one taken
    cut = F.array_join(F.slice(F.split("stage_text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words), "")
    text = F.when(words < F.col("size"), cut).otherwise(F.col("stage_text"))
    whole = copies.select("doc_id", text.alias("text"), "stage_rest.*")
    if "n_chars" in own:
        whole = whole.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: bin_id, capacity, n_words, pieces (with their texts as they were), text."""
    return packing.sequences(docs)


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_lines),
    ("near_dedup", one_of_each),
    ("mixing", mixture),
    ("packing", packed),
]

#: Language identification and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.only(docs)  # the stage before was read for the last time
    return docs
