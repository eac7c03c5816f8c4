"""Null ids, ids with several texts, and columns that have the operators' inner names, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trifold.llm import decontam, hilbert, licences, neardup, packing, pii, quality_fm, sketch, tokenbits, toxicity

CLASHING = ["__bad", "__gone", "__labelled", "__salt", "hilbert", "__of", "__terms", "__alone", "run", "end", "salt", "key", "cid", "shard", "kept", "words", "bucket", "text_hash", "label", "score"]
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odder(spark):
    texts = ["one text that many rows share with each other", "another text, quite unlike the first of them", "", None, "mail a@b.co and 10.0.0.1 today " * 3]
    rows = [(None if i % 4 == 3 else i % 3, texts[i % 5], "en" if i % 2 else None, None if i % 3 else "s", None if texts[i % 5] is None else len(texts[i % 5])) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(3)] + [(None, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quite unlike the first"), (2, None), (3, "")], "item_id long, text string").withColumns({c: F.lit(0) for c in ("n", "hash", "doc_id")})


def operators(docs, labels, bench):
    yield quality_fm.score_quality(docs, labels), True
    yield hilbert.shard_documents(docs), True
    yield pii.detect(docs), True
    yield packing.pack_documents(docs, BYTES).filter("piece = 0"), True
    yield decontam.contaminated(docs, bench), False
    yield toxicity.score_toxicity(docs, labels), True
    yield tokenbits.token_files(docs, WORDS), True
    yield sketch.fingerprints(docs), True
    yield neardup.near_duplicates(docs), True
    yield licences.scan(docs), True


def test_every_row_once(odder, labels, bench):
    for found, each in operators(odder, labels, bench):
        rows = found.collect()
        assert not each or len(rows) == odder.count()
    assert {tuple(r)[:2] for r in decontam.contaminated(odder, bench).collect()} == {(i, 1) for i in {r.doc_id for r in odder.filter("text like '%quite%'").collect()}}


def test_no_rows(odder, labels, bench):
    for found, _ in operators(odder.limit(0), labels, bench):
        assert found.count() == 0
    for found, each in operators(odder, labels.limit(0), bench.limit(0)):
        assert found.count() == (odder.count() if each else 0)


def test_one_id(odder, labels, bench):
    for found, each in operators(odder.withColumn("doc_id", F.lit(7).cast("long")), labels, bench):
        assert not each or found.count() == odder.count()


def test_filters_keep_columns(odder, labels, bench):
    kept = [quality_fm.good_documents(odder, labels), neardup.one_of_each(odder), decontam.without_benchmark(odder, bench), pii.sanitised(odder)]
    for found in kept:
        assert found.columns == odder.columns
        found.collect()
    assert kept[3].count() == odder.count() and kept[2].filter("text like '%quite%'").count() == 0


def test_stages(spark, odder, tmp_path):
    """The stages in order over the odd rows, with tables of the given kinds."""
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a passage that is in no document at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odder.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "piece"]
