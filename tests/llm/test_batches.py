"""Rows reach Python workers in small batches, and what operators make of them does not depend on where batches end."""

from types import SimpleNamespace

import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlake.llm import bpe
from barlake.session import BATCH_BYTES, small_batches


@pytest.fixture
def unset(spark):
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    yield spark
    spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def test_stages_hand_texts_over_in_small_batches(unset, sf):
    spark = unset
    text = F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 2000)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    corpus_pipeline.tokenize(spark, docs, sf)
    n, most = docs.mapInArrow(size, "n long, bytes long").agg(F.sum("n"), F.max("bytes")).first()
    assert n == 400 and most < 2 << 20  # all texts are 6 MB


def test_a_session_keeps_its_own_size(unset):
    unset.conf.set(BATCH_BYTES, "12345")
    small_batches(unset)
    assert unset.conf.get(BATCH_BYTES) == "12345"


def test_chunks_do_not_end_with_batches(monkeypatch):
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    texts = ["one two", None, "", "two three ", "x" * 50, "one"] * 5
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    cut = lambda step: list(bpe._chunks((rows.slice(i, step) for i in range(0, len(texts), step)), 1, [0], {"one": 0}, r"\w+"))
    assert len(cut(4)) == 1 and cut(4)[0].equals(cut(len(texts))[0])
    assert cut(4)[0].column("rows")[0].as_py() == [{"doc_id": i} for i in range(len(texts))]
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 120)
    parts = cut(1)
    assert len(parts) > 2 and [r["doc_id"] for p in parts for r in p.column("rows")[0].as_py()] == list(range(len(texts)))
    assert [p.column("chunk")[0].as_py() for p in parts] == list(range(len(parts)))
    assert list(bpe._chunks(iter([rows.slice(0, 0)]), 1, [0], {"one": 0}, r"\w+")) == []
