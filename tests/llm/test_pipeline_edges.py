"""The corpus pipeline on null and repeated ids, clashing names and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def folder_of(spark, at, rows, extra):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")})
    for name in extra:
        docs = docs.withColumn(name, F.lit("own"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k == 2)) for k in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, "which planet of the solar system has the largest number of known moons today")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("extra", [(), ("score", "n", "node", "ids")])
def test_odd_rows_come_through(shipped, odd, tmp_path, extra):
    clean = "a quiet morning by the river with nothing else to say about it at all"
    rows = [*odd, (20, clean), (20, clean), (None, clean), (21, "we asked which planet of the solar system has the largest number of known moons today and went home")]
    found = corpus_pipeline.run(shipped, folder_of(shipped, tmp_path, rows, extra)).collect()
    ids = [r.doc_id for r in found]
    assert 21 not in ids and ids.count(20) == 1  # a copy of a test item; one of the repeated rows
    assert {1, 2, 3, 6, 7} <= set(ids)  # nothing else takes out rows without words or long ones
    (row,) = [r for r in found if r.doc_id == 20]
    assert row.decoded_sha256 == hashlib.sha256(clean.encode()).hexdigest()


def test_empty_documents(shipped, tmp_path):
    found = corpus_pipeline.run(shipped, folder_of(shipped, tmp_path, [], ()))
    assert found.collect() == [] and found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
