"""The stored log table: Parquet, one directory per day and load."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.mapping import NANOS_MAX, NANOS_MIN, NS_PER_DAY
from ..functions.times import day_col, day_of
from ..operators.filters import in_range
from ..schema import LOGS, PARTITION_COLUMNS, RESULT_COLUMNS, STORED_LOGS
from . import traces
from .files import delete, folders, move, read_text, write_text

# Days a row is kept, false-positive rate of the trace filter.
RETENTION_DAYS = 30
BLOOM_FPP = "0.01"

# Compaction: a day's load that holds others, where it is staged, the list of loads
# it holds, and the column with the load of each row (in these files only).
COMPACTED = "load_id=compacted"
STAGED = "_compaction"
LOADS = "_LOADS"
SOURCE = "source_load"


def read_logs(
    spark: SparkSession, path: str, start: int | None = None, end: int | None = None
) -> DataFrame:
    """The table as the search functions take it, with `tenant_id` and `day`.

    With a range of stamps only the folders of its days are listed: the cost of
    planning a search follows the days it asks for, not the age of the table. The
    rows are those of these days; the search itself cuts to the stamp.
    """
    reader = spark.read.schema(STORED_LOGS)
    if start is None and end is None:
        return reader.parquet(path)
    first, last = (
        day_of(max(NANOS_MIN, min(NANOS_MAX, ns))).isoformat()
        for ns in (NANOS_MIN if start is None else start, NANOS_MAX if end is None else end - 1)
    )
    days = [p for p in folders(spark, f"{path}/day=*") if first <= p.rpartition("day=")[2] <= last]
    if not days:
        return spark.createDataFrame([], STORED_LOGS)
    return reader.option("basePath", path).parquet(*days)


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """The table in result form: eight columns in fixed order, no tenant."""
    return read_logs(spark, path).select(*RESULT_COLUMNS)


def folder_name(load_id: str) -> str:
    """The load's name in folders: what a storage, a glob or Spark itself would read
    otherwise is written as ~ and two hexadecimal digits per byte."""
    if not load_id:
        raise ValueError("a load needs an id")
    coded = re.sub(
        r"[^A-Za-z0-9._-]", lambda m: "".join(f"~{b:02X}" for b in m[0].encode()), load_id
    )
    return f"~{ord(coded[0]):02X}{coded[1:]}" if coded == COMPACTED.partition("=")[2] else coded


def append_logs(
    rows: DataFrame, path: str, load_id: str, fresh: bool = False, index: bool = True
) -> None:
    """Store rows by day, clustered by (tenant, service, ts).

    One shuffle on (day, tenant). It is a rebalance, so adaptive execution
    splits a day or tenant that holds a large share of the rows over many
    writers and merges small ones. `load_id` names this load: what an earlier
    attempt has stored under it goes first, in all days, so that storing it again
    leaves exactly the rows given now, be they fewer, of other days or none. That
    holds for what `compact_days` has taken over since, too: those days are rewritten.

    `fresh` promises that no load of this id was ever stored: nothing is looked up
    then, so that the cost of storing does not follow the table's age. The load's
    traces are indexed (see `traces`); without `index` the load stays marked instead, which
    saves a job now, and a trace lookup looks into it until its days are compacted.
    """
    spark, load = rows.sparkSession, folder_name(load_id)
    if not fresh:
        _take_out(spark, path, load)
        for folder in folders(spark, f"{path}/day=*/load_id={load}"):
            delete(spark, folder)
    marked = traces.begin(spark, path, load)
    stored = rows.select(*LOGS.names).withColumns(
        {"day": day_col(F.col("ts")), "load_id": F.lit(load)}
    )
    clustered = stored.hint(
        "rebalance", F.col("day"), F.col("tenant_id")
    ).sortWithinPartitions(*PARTITION_COLUMNS, "tenant_id", "service", "ts")
    _write(clustered, path, PARTITION_COLUMNS)
    if marked:
        (traces.add_load if index else traces.settle)(spark, path, load)


def _write(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet with a trace filter whose size follows the traces of each row group."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.bloom.filter.fpp#trace_id", BLOOM_FPP)
        .partitionBy(*by)
        .parquet(path)
    )


def apply_retention(logs: DataFrame, now_ns: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows that have not expired; whole expired days are not even listed for reading."""
    return in_range(logs, now_ns - days * NS_PER_DAY, NANOS_MAX)


def drop_expired_days(
    spark: SparkSession, path: str, now_ns: int, days: int = RETENTION_DAYS
) -> list[str]:
    """Delete the directories of days that lie wholly before the retention time.

    Touches directory names only, one per stored day. The day the limit falls
    into stays; `apply_retention` hides its expired rows.
    """
    first_kept = day_of(now_ns - days * NS_PER_DAY)
    dropped = []
    for staged in folders(spark, f"{path}/{STAGED}/day=*"):
        if staged.rpartition("day=")[2] < first_kept.isoformat():
            delete(spark, staged)
    for folder in folders(spark, f"{path}/day=*"):
        day = folder.rpartition("day=")[2]
        if day < first_kept.isoformat():
            delete(spark, folder)
            dropped.append(day)
    return dropped


def compact_days(spark: SparkSession, path: str, before_ns: int) -> list[str]:
    """Rewrite the loads of each day that ended before `before_ns` as one load.

    Continuous ingest leaves a folder per micro-batch; after this a day has few,
    large files in (tenant, service, ts) order. A copy is staged beside the days,
    with a list of the loads it holds; the list completes it. Then the loads of the
    list go and the copy takes their place. If this stops in between, readers miss
    the loads already gone until the next call, which finishes complete copies
    first. Loads stored since staging are not on the list and stay. Rows keep the
    name of their load, so `append_logs` can still replace it. Days are rewritten
    one by one; only one call, or replay of a load taken over, may run at a time.
    """
    staged = _staged_days(spark, path)
    taken = set().union(*(_loads_of(spark, f"{path}/{STAGED}/day={day}") for day in staged))
    done = {_finish(spark, path, day) for day in staged}
    for folder in folders(spark, f"{path}/day=*"):
        day = folder.rpartition("day=")[2]
        loads = folders(spark, f"{folder}/load_id=*")
        ready = [p for p in loads if p.endswith(COMPACTED)]
        if day >= day_of(before_ns).isoformat() or len(loads) - len(ready) < (1 if ready else 2):
            continue
        held = {p.rpartition("load_id=")[2] for p in loads if p not in ready}
        taken |= held
        _stage(spark, path, day, _with_source(spark, path, loads), held | _loads_of(spark, f"{folder}/{COMPACTED}"))
        done.add(_finish(spark, path, day))
    if traces.is_indexed(spark, path):
        traces.merge(spark, path, taken)
    return sorted(done)


def _staged_days(spark: SparkSession, path: str) -> list[str]:
    """Days with a complete copy that has not taken its place."""
    lists = folders(spark, f"{path}/{STAGED}/day=*/{LOADS}")
    return [p.rpartition("day=")[2].partition("/")[0] for p in lists]


def _loads_of(spark: SparkSession, folder: str) -> set[str]:
    """The loads that a copy holds."""
    lists = folders(spark, f"{folder}/{LOADS}")
    return set(json.loads(read_text(spark, lists[0]))) if lists else set()


def _with_source(spark: SparkSession, path: str, loads: list[str]) -> DataFrame:
    """Rows of some loads of a day, each with the load that first stored it."""
    schema = StructType([*STORED_LOGS.fields, StructField(SOURCE, StringType())])
    rows = spark.read.schema(schema).option("basePath", path).parquet(*loads)
    return rows.select(*LOGS.names, F.coalesce(SOURCE, "load_id").alias(SOURCE))


def _stage(spark: SparkSession, path: str, day: str, rows: DataFrame, held: set[str]) -> None:
    staged = f"{path}/{STAGED}/day={day}"
    clustered = rows.hint("rebalance", F.col("tenant_id"))
    _write(clustered.sortWithinPartitions("tenant_id", "service", "ts"), staged)
    if held.intersection(traces.marked_loads(spark, path)):  # their entries are not written yet
        hashes = spark.read.schema(LOGS).parquet(staged).where("trace_id != ''")
        entries = hashes.select(traces.trace_hash(F.col("trace_id")).alias("trace_hash"), F.lit(day).cast("date").alias("day"))
        traces.write_entries(entries.distinct(), path, f"day-{day}-{uuid.uuid4().hex}")
    write_text(spark, f"{staged}/{LOADS}", json.dumps(sorted(held)))


def _finish(spark: SparkSession, path: str, day: str) -> str:
    """Put a complete copy in the place of the loads it holds."""
    staged, folder = f"{path}/{STAGED}/day={day}", f"{path}/day={day}"
    held = _loads_of(spark, staged)
    for load in folders(spark, f"{folder}/load_id=*"):
        if load.endswith(COMPACTED) or load.rpartition("load_id=")[2] in held:
            delete(spark, load)
    move(spark, staged, f"{folder}/{COMPACTED}")
    return day


def _take_out(spark: SparkSession, path: str, load_id: str) -> None:
    """Remove a load from the copies that hold it."""
    for day in _staged_days(spark, path):
        copies = f"{path}/{STAGED}/day={day}", f"{path}/day={day}/{COMPACTED}"
        if any(load_id in _loads_of(spark, copy) for copy in copies):
            _finish(spark, path, day)
    for listed in folders(spark, f"{path}/day=*/{COMPACTED}/{LOADS}"):
        copy = listed.rpartition("/")[0]
        held = _loads_of(spark, copy)
        if load_id not in held:
            continue
        if held == {load_id}:
            delete(spark, copy)
            continue
        day = copy.rpartition("day=")[2].partition("/")[0]
        rows = _with_source(spark, path, [copy]).filter(F.col(SOURCE) != load_id)
        _stage(spark, path, day, rows, held - {load_id})
        _finish(spark, path, day)
