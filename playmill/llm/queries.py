"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmill.llm import chat, lines, merkle, near, onebit, oracles, packing, pieces, quality, sharding, toxicity, urls, voronoi, whitening


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; PLAYMILL_TOKENIZERS names another folder."""
    if folder := os.environ.get("PLAYMILL_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op2_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every 50th vector."""
    return voronoi.voronoi_top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur earlier, and what was removed."""
    cut = lines.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "removed", F.aggregate("removed", F.lit(0), lambda n, r: n + r["end"] - r["start"]).cast("long").alias("removed_chars"))


def op4_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours found for every 100th vector."""
    return onebit.one_bit_neighbours(_table(spark, sf_dir, "embeddings"), k=10, every=100)


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    judged = urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the spans that made it."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "spans")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents under two-word shingles."""
    return near.near_duplicates(_table(spark, sf_dir, "documents"), near.NearSettings(width=2))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents placed in eight shards under the key law."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


#: (conv_id, turn, role, text) of a conversation that holds the template's own marks
ODD_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as prefix-target examples with their whole context, read back."""
    odd = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in ODD_CONVERSATION])))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.whole_examples(chat.chat_examples(rows.unionByName(odd))))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    return whitening.whiten_embeddings(_table(spark, sf_dir, "embeddings"), components=16)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what a tampered one leads to."""
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_voronoi_top_k": op2_voronoi_top_k,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_one_bit_codes": op4_one_bit_codes,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op2_voronoi_top_k": oracles.top_k_sql(k=5, every=50, scale=256),
    "op5_url_filter": oracles.url_sql(URL_RULES, damping=0.85, rounds=8, threshold=0.5),
    "op11_chat_formatting": oracles.chat_sql(ODD_CONVERSATION, block=64),
    "op13_merkle_manifest": oracles.merkle_sql(fanout=3),
}
