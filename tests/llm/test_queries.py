"""Registered corpus queries: against SQL where there is some, and the pipeline's stages."""

from __future__ import annotations

import os
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aspectra.llm.oracle import ORACLE
from aspectra.llm.queries import QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import open_tables, spark_rows, sql_rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(open_tables(sf), ORACLE[name])


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_stages(spark, sf, tmp_path):
    """What every stage must keep, and that its decisions take effect."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    before, after = seen["near_dedup"]
    assert 0 < after.count() < before.count() and after.select("doc_id").distinct().count() == after.count()
    assert before.groupBy("text").count().count() >= after.select("text").distinct().count() == after.count()
    before, after = seen["personal_data"]
    assert before.count() == after.count()
    assert after.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+[.]")).count() == 0 < after.where(F.col("text").contains("[EMAIL]")).count()
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["source_mix"]
    copies = after.groupBy("doc_id").count()
    assert copies.where("count > 2").count() == 0 and copies.join(before, "doc_id", "left_anti").count() == 0
    before, after = seen["packing"]
    assert after.where("start = 0").count() == before.count()
    assert after.agg(F.countDistinct("sequence_id")).first()[0] == -(-after.agg(F.sum("length")).first()[0] // 1024)


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
