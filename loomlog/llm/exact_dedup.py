"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

A load is reduced to one row per digest, the digests already indexed are taken
out by a sort-merge anti-join against the index (which needs no shuffle, being
bucketed), and the rest is appended. Texts are never shuffled, only digests.
Everything is DataFrame expressions.

Defined cases: texts of any length count by the digest of all of them. A null text counts as empty, so all null and empty texts are
equal. Of equal texts in one load the row with the largest doc_id stays (null
ids last; of fully equal rows one). A text that an earlier load has indexed
loses to it, whatever its id; a load given again gets the same answer, because
the index remembers which id it kept. Other columns are ignored, whatever their
names. An empty load adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import few_rows, stored, text_of
from loomlog.session import scratch_path


class DigestIndex:
    """Digests of all texts seen so far: one row (digest, keep_id) for each."""

    def __init__(
        self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None
    ):
        """`name` in the session's catalog; `path` in storage all executors reach.

        `buckets` is fixed when the table is made; choose it so that a bucket of
        the final index (about 50 bytes a text) sorts in one task's memory.
        """
        self.spark, self.name = spark, name
        self.path = path or scratch_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            self._write(few_rows(spark, [], "digest binary, keep_id bigint"), "errorifexists")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, mode: str) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .mode(mode)
            .saveAsTable(self.name)
        )

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a load and return its decisions, one row per row of `docs`:
        doc_id, keep_id, group_size (in this load), kept, text_sha256.
        """
        rows = stored(
            docs.select(
                "doc_id",
                F.unhex(F.sha2(text_of(), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        groups = stored(
            rows.groupBy("digest").agg(
                F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")
            ),
            "digest-groups",
        )
        index = self.table()
        fresh = groups.join(index.hint("merge"), "digest", "left_anti")
        self._write(fresh.select("digest", F.col("best.doc_id").alias("keep_id")), "append")
        self.spark.catalog.refreshTable(self.name)
        winners = stored(groups.join(self.table().hint("merge"), "digest"), "digest-winners")
        return rows.join(winners.hint("merge"), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("row") == F.col("best.row")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index under a name of its own, in the shared scratch folder."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs` that stay, with their columns."""
    index = index or new_index(docs.sparkSession)
    kept = index.add(docs).where("kept")
    return one_row_each(docs, kept.select("doc_id", F.unhex("text_sha256").alias("digest")))


def one_row_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of `docs` whose id and text digest are `chosen` (doc_id, digest), with
    their columns; of several rows with the same id and text, one.
    """
    digest = F.unhex(F.sha2(text_of(), 256))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of")).distinct()
    # Rows that repeat an id with the same text are rare: only they are compared whole.
    times = docs.select("doc_id", digest.alias("_of")).groupBy("doc_id", "_of").count()
    chosen = stored(
        chosen.join(
            times.withColumnRenamed("doc_id", "_doc").withColumnRenamed("_of", "_doc_of").hint("merge"),
            (F.col("_of") == F.col("_doc_of")) & F.col("_id").eqNullSafe(F.col("_doc")),
        ).select("_id", "_of", (F.col("count") > 1).alias("_several")),
        "chosen-rows",
    )
    found = docs.withColumn("_digest", digest).join(
        chosen.hint("merge"), (F.col("_digest") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    )
    several = found.where("_several").dropDuplicates(["_digest"])
    return found.where("NOT _several").unionByName(several).select(*docs.columns)
