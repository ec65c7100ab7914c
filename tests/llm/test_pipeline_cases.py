"""The stages over empty tables, long texts, repeated and null ids, and columns of awkward names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("my col", "a.b", "__stats", "__row", "bands", "node", "score", "predicted")


def with_names(df):
    for name in NAMES:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_stages(spark, case):
    rows = [] if case == "empty" else [
        (1, "A plain text that says something. It goes on for a while, as texts do.", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "Some other plain text, with no id at all.", "en", "s", 1),
        (4, "word and other words " * 15_000, "en", "s", 1), (5, "A plain text that says something. It goes on for a while, as texts do.", "en", "t", 1), (1, "A plain text that says something. It goes on for a while, as texts do.", "en", "s", 1),
    ]
    docs = with_names(spark.createDataFrame(rows, DOCS))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
            kept = corpus_pipeline.materialize(out, "test")
            assert kept.count() <= docs.count()
            docs = kept
        else:
            packed = out.collect()
            assert sorted({r.doc_id for r in packed}, key=repr) == sorted({r.doc_id for r in docs.select("doc_id").collect()}, key=repr)
