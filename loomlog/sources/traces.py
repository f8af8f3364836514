"""Index of the stored log table by trace: hash of a trace id to the days that hold it.

It lies beside the days, in `_traces`: one folder per load, and, once days are compacted,
one for all of them, sorted by hash, so that a lookup opens the one row group that can hold
its hash. An entry may name a day that has lost its rows (they expired, or a replay stored
fewer); no stored row is ever without an entry, or without the mark of its load: a load is
marked before its rows are written, and the mark goes when its entries are complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STORED_LOGS
from .files import delete, folders, touch

TRACES = "_traces"
MARKS = f"{TRACES}/_marks"
ENTRIES = "trace_hash bigint, day date"


def trace_hash(trace_id: Column) -> Column:
    return F.xxhash64(trace_id)


def is_indexed(spark: SparkSession, path: str) -> bool:
    return bool(folders(spark, f"{path}/{TRACES}"))


def begin(spark: SparkSession, path: str, load: str) -> bool:
    """Mark a load that will be stored; False where an older table has no index."""
    if not is_indexed(spark, path) and folders(spark, f"{path}/day=*"):
        return False
    touch(spark, f"{path}/{MARKS}/load_id={load}")
    return True


def add_load(spark: SparkSession, path: str, load: str) -> None:
    """Index what a marked load has stored, and take its mark away."""
    stored = folders(spark, f"{path}/day=*/load_id={load}")
    write_entries(entries_of(spark, path, stored), path, load)
    delete(spark, f"{path}/{MARKS}/load_id={load}")


def entries_of(spark: SparkSession, path: str, stored: list[str]) -> DataFrame:
    """(trace_hash, day) of the rows in some folders of the table."""
    if not stored:
        return spark.createDataFrame([], ENTRIES)
    rows = spark.read.schema(STORED_LOGS).option("basePath", path).parquet(*stored)
    return rows.where("trace_id != ''").select(trace_hash(F.col("trace_id")).alias("trace_hash"), "day").distinct()


def write_entries(entries: DataFrame, path: str, name: str) -> None:
    by_hash = entries.repartitionByRange("trace_hash").sortWithinPartitions("trace_hash", "day")
    by_hash.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{TRACES}/load_id={name}")


def marked_loads(spark: SparkSession, path: str) -> list[str]:
    return [p.rpartition("load_id=")[2] for p in folders(spark, f"{path}/{MARKS}/load_id=*")]


def trace_days(spark: SparkSession, path: str, trace_id: str) -> list[str] | None:
    """Days that may hold the trace, by the index alone; None where there is none."""
    parts = folders(spark, f"{path}/{TRACES}/load_id=*")
    if not is_indexed(spark, path):
        return None
    if not parts:
        return []
    entries = spark.read.schema(ENTRIES).parquet(*parts)
    wanted = spark.range(1).select(trace_hash(F.lit(trace_id))).first()[0]
    days = entries.where(F.col("trace_hash") == wanted).select("day").distinct().collect()
    return sorted(r["day"].isoformat() for r in days)


def read_trace_logs(spark: SparkSession, path: str, trace_id: str) -> DataFrame:
    """The table without the days that cannot hold the trace, for `trace_lookup`.

    Lists the folders of the trace's days, and of loads whose entries are not written yet.
    """
    reader = spark.read.schema(STORED_LOGS)
    days = trace_days(spark, path, trace_id)
    if days is None:
        return reader.parquet(path)
    loads = {p for d in days for p in folders(spark, f"{path}/day={d}/load_id=*")}
    for load in marked_loads(spark, path):
        loads.update(folders(spark, f"{path}/day=*/load_id={load}"))
    if not loads:
        return spark.createDataFrame([], STORED_LOGS)
    return reader.option("basePath", path).parquet(*sorted(loads))


def rebuild(spark: SparkSession, path: str) -> None:
    """Index a table that has none, or has lost it; the marks of its loads go."""
    marks = marked_loads(spark, path)
    parts = folders(spark, f"{path}/{TRACES}/load_id=*")
    write_entries(entries_of(spark, path, folders(spark, f"{path}/day=*/load_id=*")), path, f"all-{uuid.uuid4().hex}")
    for part in [*parts, *(f"{path}/{MARKS}/load_id={load}" for load in marks)]:
        delete(spark, part)


def settle(spark: SparkSession, path: str, load: str) -> None:
    """Take the mark of a load away if no folder of it is left: it had no rows, or indexed
    copies have taken them all over."""
    if not folders(spark, f"{path}/day=*/load_id={load}"):
        delete(spark, f"{path}/{MARKS}/load_id={load}")


def merge(spark: SparkSession, path: str, taken_over: set[str]) -> None:
    """Write the entries of all loads as one, without days that are gone.

    Stopped before the last step, entries stand twice; that does no harm.
    """
    for load in taken_over.intersection(marked_loads(spark, path)):
        settle(spark, path, load)
    parts = folders(spark, f"{path}/{TRACES}/load_id=*")
    if len(parts) < 2:
        return
    days = [p.rpartition("day=")[2] for p in folders(spark, f"{path}/day=*")]
    entries = spark.read.schema(ENTRIES).parquet(*parts).where(F.col("day").cast("string").isin(days)).distinct()
    write_entries(entries, path, f"all-{uuid.uuid4().hex}")
    for part in parts:
        delete(spark, part)
