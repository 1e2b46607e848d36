"""The pipeline's stages on a small corpus, each against what its operator decides; queries against their oracles."""

import pytest
from oracle import DATA, assert_same, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fixtura.llm import queries


def test_registered():
    names = entry.queries()
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "source_mix", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLES[name])


def test_stages(spark, docs, rows, tmp_path):
    made = docs
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, made, DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        sizes.append(made.count())
    with_letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sizes[0] == len(with_letters)
    assert sizes[1] == len({r[1].translate({c: c + 32 for c in range(65, 91)}) for r in with_letters})
    assert 0 < sizes[2] < sizes[1]
    loads = made.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert loads.where("n > 2048").count() == 0


def test_run(spark):
    made = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(made.columns) and made.count() > 0


def test_empty(spark, none):
    made = none
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, DATA)
    assert made.count() == 0
