"""The registered queries: thin calls of the operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pairlab.llm import (
    collisions, jaccard, langid, merge_rounds, packing, pair_index, piecewise, pivots, recompression, sharding, templates, token_files,
    variants,
)
from pairlab.queries.base import query


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_rendezvous_shards")
def rendezvous_shards(spark, folder):
    """All documents over 16 equal shards, and over 17."""
    out = sharding.assign_shards(
        table(spark, folder, "documents"), "doc_id", "text",
        {s: 1.0 for s in range(16)}, {s: 1.0 for s in range(17)},
    )
    return out.withColumn("law", F.lit("key"))


@query("op4_token_files")
def token_files_round_trip(spark, folder):
    """All documents written as token files and read back."""
    return token_files.token_digests(
        table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )


@query("op6_best_fit_packing")
def best_fit_packing(spark, folder):
    """All documents in sequences of 4096 tokens."""
    return packing.pack(
        table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"),
        capacity=4096, end_id=1,
    )


@query("op5_byte_pair_codes")
def byte_pair_codes(spark, folder):
    """All documents encoded and decoded; digests of both."""
    out = pair_index.encode_texts(
        table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")
    )
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_piecewise_fingerprints")
def piecewise_fingerprints(spark, folder):
    """Fingerprints of all documents and of their edited texts."""
    return piecewise.compare_neighbours(table(spark, folder, "documents"), "doc_id", "text")


@query("op1_recompression_dedup")
def recompression_dedup(spark, folder):
    """All documents without the words of repeated windows of 35 words."""
    out = recompression.drop_repeats(table(spark, folder, "documents"), "doc_id", "text", width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_shingle_components")
def shingle_components(spark, folder):
    """Components of near duplicates among all documents: five words, similarity 0.75 or more."""
    out = jaccard.near_duplicates(table(spark, folder, "documents"), "doc_id", "text", width=5, at_least=(75, 100))
    return out.select("doc_id", "n_shingles", "component_id")


@query("op3_byte_cnn_language")
def byte_cnn_language(spark, folder):
    """The language of all documents, learned from those that are not held out."""
    return langid.identify_documents(table(spark, folder, "documents"), "doc_id", "text", "lang")


@query("op7_collision_neighbours")
def collision_neighbours(spark, folder):
    """The 20 nearest of all vectors for each whose id is divisible by 20."""
    return collisions.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, wanted=20)


@query("op2_template_extraction")
def template_extraction(spark, folder):
    """The main text of all pages."""
    out = templates.extract(table(spark, folder, "pages"), "page_id", "url", "html")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op11_merge_rounds")
def merge_round_pieces(spark, folder):
    """All documents as SentencePiece ids and back; digests of both."""
    out = merge_rounds.encode_texts(
        table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")
    )
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_pivot_codes")
def pivot_codes(spark, folder):
    """Codes of all vectors in 8 parts, from codebooks of 16 entries after 6 rounds."""
    out = pivots.encode(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0"))
    return out.select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
        F.sha2(F.col("codebooks").cast("binary"), 256).alias("codebooks_sha256"),
    )


@query("op12_spelling_variants")
def spelling_variants(spark, folder):
    """Words of all documents, with their near words, forms and roots."""
    return variants.group_variants(table(spark, folder, "documents"), "doc_id", "text")
