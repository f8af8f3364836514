"""What a text operator's Python workers hold, and which workers a stage starts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from loomlog.llm import packing, toxicity
from loomlog.llm.common import few_rows, handing_back

MB = 1 << 20


def test_texts_reach_python_a_few_megabytes_at_a_time(spark, documents):
    class Small:
        """Finds a text toxic that comes with more than 3 MB of others."""

        def score(self, texts):
            yield from ((float(sum(map(len, texts)) > 3 * MB), None) for _ in texts)

    docs = documents(*["word " * 1000 for _ in range(2400)]).coalesce(1)  # 12 MB
    assert toxicity.reject_toxic(docs, Small()).count() == 2400


def test_few_rows_need_no_python_in_tasks(spark):
    frame = few_rows(spark, [(1, None), (None, "x"), (1, "y")], "doc_id bigint, text string")
    assert frame.dtypes == [("doc_id", "bigint"), ("text", "string")]
    assert sorted(map(str, frame.collect())) == sorted(map(str, spark.createDataFrame([(1, None), (None, "x"), (1, "y")], frame.schema).collect()))
    plan = frame._jdf.queryExecution().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert few_rows(spark, [], "digest binary, keep_id bigint").collect() == []


def test_pieces_leave_the_packer_some_rows_at_a_time(spark):
    schema = packing.arrow_schema(packing.PIECES)
    packer = packing.Packer(packing.TIERS, packing.STEP_TOKENS, 0, schema)
    n = 2 * packing.ROWS_OUT + 10
    for i in range(n):
        packer.add(i, np.full(512, i, np.uint32).tobytes())
    packer.pack(last=True)
    batches = list(packer.packed())
    assert max(b.num_rows for b in batches) <= packing.ROWS_OUT
    rows = pa.Table.from_batches(batches, schema).to_pylist()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    assert all(r["ids"] == np.full(512, r["doc_id"], np.uint32).tobytes() for r in rows)
    assert list(packer.packed()) == []


def test_a_task_that_hands_memory_back_gives_all_its_batches(spark):
    docs = spark.range(1000, numPartitions=3)
    assert docs.mapInArrow(handing_back(lambda b: b), "id bigint").count() == 1000
    assert spark.range(0).mapInArrow(handing_back(lambda b: b), "id bigint").count() == 0
