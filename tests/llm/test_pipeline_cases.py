"""The stages one after another on odd rows, extra columns and empty tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def run_stages(spark, docs):
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        seen.append((name, rows))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before, name
            docs = spark.createDataFrame(rows, docs.schema)
    return dict(seen)


def test_odd_rows_and_clashing_columns_go_through_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [
        (None, None, None, None, None), (9001, None, None, None, None), (9001, "", "en", "s", 0), (9002, "same text here", None, "s", 1),
        (9002, "same text here", None, "s", 1), (9003, "same text here", None, None, 1), (9004, "one", None, "t", 3),
        (9005, "word " * 30_000, None, "t", 150_000),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    names = "digest keep_id kept size copies key node class_id score class bands sketch members part"
    docs = docs.withColumns({n: F.lit("x") for n in names.split()})
    got = run_stages(spark, docs)
    kept = [r.doc_id for r in got["exact_dedup"]]
    assert kept.count(9003) == 1 and 9002 not in kept  # of equal texts the largest id
    assert sum(r.text in (None, "") for r in got["exact_dedup"]) <= 1
    assert {r.doc_id for r in got["near_dedup"]} <= set(kept) and 9005 in kept
    pieces = [r for r in got["packing"] if r.doc_id == 9005]
    copies = sum(r.doc_id == 9005 for r in got["source_mix"])
    assert sum(r.length for r in pieces) == copies * (pieces[0].doc_tokens if pieces else 0)


def test_empty_tables_go_through_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert all(rows == [] for rows in run_stages(spark, docs).values())
