"""Equal rows: removal, comparison of two tables, fingerprints, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# Hash ranges that are summed apart.
RANGES = 4096


def dedup(rows: DataFrame) -> DataFrame:
    """One row of each set of equal rows, maps compared by content.

    A grouping without sort or hash column: copies collapse on the map side,
    so a row repeated any number of times reaches the shuffle once per task.
    """
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies")).drop("_copies")


def _canonical(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, T.MapType):
        return F.sort_array(F.map_entries(column)).alias(field.name)
    return column


def fingerprint_col(rows: DataFrame) -> Column:
    """SHA-256 over all columns; equal rows have equal fingerprints."""
    return F.sha2(F.to_json(F.struct(*map(_canonical, rows.schema))), 256)


def with_fingerprint(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fingerprint", fingerprint_col(rows))


def diff_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with `surplus` = left minus right.

    One signed grouping instead of two set differences: a single shuffle,
    combined on the map side, and map columns are allowed.
    """
    columns = left.columns
    both = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*columns).withColumn("_side", F.lit(-1))
    )
    return (
        both.groupBy(*columns)
        .agg(F.sum("_side").alias("surplus"))
        .filter(F.col("surplus") != 0)
    )


def _row_hash(rows: DataFrame, salt: str = "") -> Column:
    """64-bit hash of all columns. A null leaves a hash as it is, so which are null counts too."""
    nulls = F.concat(F.lit(salt), *[F.when(F.col(c).isNull(), "0").otherwise("1") for c in rows.columns])
    return F.xxhash64(nulls, *map(_canonical, rows.schema))


def checksums(rows: DataFrame, ranges: int) -> DataFrame:
    """Count and hash sums of the rows of each hash range, whatever their order.

    Two 64-bit hashes of all columns are summed in halves of 32 bits, so no sum
    overflows below 2^31 rows a range. What is shuffled is one row per range and task.
    """
    hashed = rows.select(_row_hash(rows).alias("h1"), _row_hash(rows, "second").alias("h2"))
    low = lambda h: F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda h: F.shiftrightunsigned(h, 32)
    sums = [F.sum(half(h)) for h in ("h1", "h2") for half in (low, high)]
    return hashed.groupBy(F.pmod("h1", F.lit(ranges)).alias("range")).agg(F.struct(F.count("*"), *sums).alias("sums"))


def diff_stored(left: DataFrame, right: DataFrame, ranges: int = RANGES) -> DataFrame:
    """What `diff_tables` gives, for tables that differ in few rows or none.

    Runs the comparison of checksums at once. Where all agree, nothing else is read;
    else the two hashes of the rows of ranges that differ are counted on both sides, and
    only rows whose hashes stand unequally often are shuffled whole and compared. At most
    `ranges` numbers reach the driver. Different rows escape if both 64-bit sums of their
    range, or both their own hashes, agree by chance.
    """
    right = right.select(*left.columns)
    theirs = checksums(right, ranges).withColumnRenamed("sums", "theirs")
    both = checksums(left, ranges).join(theirs, "range", "full")
    differing = [r["range"] for r in both.where("NOT (sums <=> theirs)").select("range").collect()]
    if not differing:
        return left.withColumn("surplus", F.lit(0).cast("bigint")).limit(0)

    def hashed(rows: DataFrame, side: int) -> DataFrame:
        found = rows.select(_row_hash(rows).alias("h1"), _row_hash(rows, "second").alias("h2"))
        if 2 * len(differing) < ranges:  # else a long list to ask for leaves little out
            found = found.where(F.pmod("h1", F.lit(ranges)).isin(differing))
        return found.select("h1", "h2", F.lit(side).alias("_side"))

    surplus = hashed(left, 1).unionByName(hashed(right, -1)).groupBy("h1", "h2").agg(F.sum("_side").alias("surplus"))
    unequal = surplus.where("surplus != 0").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    path = scratch_path(left.sparkSession, "unequal")
    unequal.write.parquet(path)  # its real size decides how it is joined
    unequal = left.sparkSession.read.schema(unequal.schema).parquet(path)

    def within(rows: DataFrame) -> DataFrame:
        same = (_row_hash(rows) == unequal["_h1"]) & (_row_hash(rows, "second") == unequal["_h2"])
        return rows.join(unequal, same, "left_semi")

    return diff_tables(within(left), within(right))
