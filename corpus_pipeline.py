"""Documents to packed training sequences: four stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import jaccard, langid, packing, recompression
from pairlab.queries.base import query
from pairlab.session import scratch_path

#: Below this mean probability no language holds a document.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language: those of unknown language, or without one that holds half of them, go.

    The network learns from the labelled documents that are not held out. Rows that are equal in
    doc_id and text are judged alike; all stay or all go. Null texts go. Without any labelled text
    to learn from nothing can be judged, and all stay.
    """
    others = [c for c in docs.columns if c != "text"]
    carried = docs.select(F.struct(*others).alias("row"), "text", "lang", "doc_id")
    training = carried.filter(~langid.held_out(F.col("doc_id")))
    net = langid.learn(training, "text", "lang", F.col("doc_id"))
    if net is None:
        return docs
    judged = langid.identify(carried, "row", "text", net, keep_text=True)
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*", "text").select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity 0.75 or more.

    The smallest doc_id stays. Of rows equal in doc_id and text, which are near duplicates too, one
    stays; a document is known by both, so that nothing depends on how the table is read twice.
    Documents without words link with nothing and all stay.
    """
    known = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    carried = docs.select(F.struct(*docs.columns).alias("row"), known.alias("known"), "text")
    judged = jaccard.near_duplicates(carried, "known", "text", width=5, at_least=(75, 100))
    gone = judged.groupBy("known").agg(
        F.max(F.col("stays").cast("int")).alias("stays"), F.max("n_shingles").alias("n")
    )
    stay = gone.filter("stays = 1").select(F.col("known").alias("own"), (F.col("n") > 0).alias("worded"))
    kept = carried.join(stay, F.col("known").eqNullSafe(F.col("own"))).select("row", "known", "worded")
    worded = kept.filter("worded").dropDuplicates(["known"])
    return worded.unionByName(kept.filter("not worded")).select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 35-word windows; what is left is joined by one space.

    n_chars follows the new text. A document that loses all its words stays, with an empty text; null
    and empty texts stay as empty ones.
    """
    others = [c for c in docs.columns if c != "text"]
    carried = docs.select(F.struct(*others).alias("row"), "text")
    out = recompression.drop_repeats(carried, "row", "text", width=35).select("row.*", F.col("kept").alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents, placed in sequences of 4096 tokens. Null and empty texts are an end id alone."""
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]
#: No stage can be written in SQL; tests compare with brute force instead.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
