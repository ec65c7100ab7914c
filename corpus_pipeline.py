"""Corpus pipeline: toxicity, quality, near-dedup, substring dedup and packing over ``documents``.

Each stage takes all that its predecessor kept; all but the last return the columns of documents.

Cases: a null or empty text is scored like any text, linked with nothing, and packed as its end id if it is kept; rows
without a doc_id pass the stages that reject by doc_id; all rows of a rejected doc_id go; of repeated rows of one doc_id
the near-dedup stage keeps one; very long texts are handled whole; extra columns are kept up to packing, whatever their
names, but for one named ``removed``, which the substring stage fills with what it cut; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmill.llm import lines, near, packing, quality, toxicity
from playmill.llm.common import columns_of, drop_scratch, free_name, materialize, restrict, scratch_scope
from playmill.llm.queries import tokenizer_file


def _keep(docs: DataFrame, scored: DataFrame, wanted: int) -> DataFrame:
    """Rows of ``docs`` but those whose doc_id is predicted otherwise than ``wanted``."""
    return restrict(docs, materialize(scored.where(F.col("predicted") != wanted).select("doc_id").distinct(), "rejected"), "left_anti")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxic-span tagger rejects go."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keep(docs, toxicity.toxicity_scores(docs, model, with_spans=False), 0)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = free_name(docs, "__stats")
    return quality.with_stats(docs, stats).where(model.column(stats) >= 0.5).select(*columns_of(docs))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles at 0.8) stays: the one with the smallest doc_id."""
    found = near.near_duplicates(docs, near.NearSettings(width=5))
    kept = restrict(docs, materialize(found.where("not kept").select("doc_id").distinct(), "rejected"), "left_anti")
    repeated = materialize(kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    return restrict(kept, repeated, "left_anti").unionByName(restrict(kept, repeated).dropDuplicates(["doc_id"]))


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; documents with nothing left go."""
    cut = lines.remove_repeats(docs)
    left = cut.where((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*columns_of(docs))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality classifier", stage_quality),
    ("MinHash near-dedup", stage_near_dedup),
    ("substring dedup", stage_substring_dedup),
    ("packing", stage_packing),
]

#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread by the next.

    What a stage wrote on its way is deleted with its input once its output is written.
    """
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch_scope() as own:
            out = stage(spark, docs, sf_dir)
            with scratch_scope() as kept:
                docs = materialize(out, f"stage-{k}")
        drop_scratch(spark, own + held)
        held = kept
    return STAGES[-1][1](spark, docs, sf_dir)
