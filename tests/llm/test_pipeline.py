"""The pipeline against its operators, stage by stage, and the contracts of the queries."""

import corpus_pipeline
from playmill.llm import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op2": {"query_id", "rank", "vec_id", "score"},
    "op3": {"doc_id", "text", "removed"},
    "op4": {"query_id", "rank", "vec_id", "score"},
    "op5": {"page_id", "host", "path", "rule", "verdict"},
    "op6": {"doc_id", "held_out", "score", "predicted"},
    "op7": {"doc_id", "n_shingles", "component_id", "kept"},
    "op8": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op9": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op10": {"doc_id", "held_out", "score", "predicted"},
    "op11": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op12": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op13": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
}


def test_contracts(spark):
    for name, f in queries.QUERIES.items():
        df = f(spark, SF)
        assert COLUMNS[name.split("_")[0]] <= set(df.columns) and df.count() > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        if k < 4:
            assert out.columns == columns
            out = corpus_pipeline.materialize(out, "test")
            assert 0 < out.count() <= kept.count()
            assert out.select("doc_id").exceptAll(kept.select("doc_id")).count() == 0
            kept = out
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_null_ids_and_extra_rows(spark):
    docs = spark.createDataFrame([(None, "some text here.", "en", "s", 1), (1, None, None, None, None), (2, "x y z " * 50, "en", "s", 1), (2, "x y z " * 50, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        docs.count()


def test_near_stage_takes_five_words(spark):
    words = [f"w{i}" for i in range(100)]
    changed = [f"z{i}" if i % 20 == 10 else w for i, w in enumerate(words)]  # five of a hundred words: 0.82 at width 2, 0.61 at width 5
    texts = [" ".join(words), " ".join(changed), " ".join([*words, "tail"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.stage_near_dedup(spark, docs, SF).collect()) == [0, 1]
