"""The index of traces: which days a lookup reads, what it skips, and that it misses nothing."""

from __future__ import annotations

from pathlib import Path

import pytest
from helpers import DAY, NOW, log_row

from loomlog.plans.search import trace_lookup
from loomlog.schema import LOGS
from loomlog.sources import logs as store
from loomlog.sources import traces
from loomlog.sources.logs import append_logs, compact_days, drop_expired_days, folder_name, read_logs
from loomlog.sources.traces import read_trace_logs


def put(spark, path, load, *stamped, **how):
    rows = [log_row(ts=ts, trace=trace, body=f"{load} {i}") for i, (ts, trace) in enumerate(stamped)]
    append_logs(spark.createDataFrame(rows, LOGS), path, load, **how)


def found(spark, path, trace):
    return sorted(r.body for r in trace_lookup(read_trace_logs(spark, path, trace), "a", trace).collect())


def name(n):
    return f"{n:032x}"


def days_read(frame):
    return {p.split("day=")[1][:10] for p in frame.inputFiles()}


def test_a_lookup_reads_only_the_days_of_its_trace(spark, tmp_path):
    path = str(tmp_path / "logs")
    put(spark, path, "all", *[(NOW - d * DAY, name(t)) for d in range(30) for t in (d, 1000 + d // 10, 7)])
    assert len(list(Path(path).glob("day=*"))) == 30
    assert len(days_read(read_trace_logs(spark, path, name(12)))) == 1
    assert len(days_read(read_trace_logs(spark, path, name(1001)))) == 10
    assert len(days_read(read_trace_logs(spark, path, name(7)))) == 30
    assert read_trace_logs(spark, path, "f" * 32).inputFiles() == []
    assert len(found(spark, path, name(1001))) == 10 and found(spark, path, "f" * 32) == []
    put(spark, path, "later", (NOW - 3 * DAY, name(12)))
    assert days_read(read_trace_logs(spark, path, name(12))) == {"2024-01-28", "2024-01-19"}


def test_loads_without_entries_are_looked_into_until_compacted(spark, tmp_path):
    path = str(tmp_path / "logs")
    put(spark, path, "a", (NOW - 2 * DAY, name(1)), (NOW, name(2)), index=False)
    put(spark, path, "b", (NOW - 2 * DAY, name(3)), (NOW - 2 * DAY, ""), index=False)
    put(spark, path, "none", index=False)
    assert traces.marked_loads(spark, path) == ["a", "b"]
    assert found(spark, path, name(1)) == ["a 0"] and found(spark, path, name(3)) == ["b 0"]
    compact_days(spark, path, NOW)
    assert traces.marked_loads(spark, path) == ["a"]  # its last day is not compacted
    assert found(spark, path, name(1)) == ["a 0"] and found(spark, path, name(2)) == ["a 1"]
    put(spark, path, "c", (NOW, name(3)))
    compact_days(spark, path, NOW + DAY)
    assert traces.marked_loads(spark, path) == []
    assert len(list(Path(path).glob("_traces/load_id=*"))) == 1
    assert found(spark, path, name(3)) == ["b 0", "c 0"] and found(spark, path, name(2)) == ["a 1"]
    assert days_read(read_trace_logs(spark, path, name(1))) == {"2024-01-29"}
    entries = spark.read.parquet(*[str(p) for p in Path(path).glob("_traces/load_id=*")])
    assert entries.where("trace_hash = xxhash64('')").count() == 0


@pytest.mark.parametrize("step", ["begin", "_write", "write_entries"])
def test_a_load_stopped_at_any_step_is_found_after_its_replay(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "logs")
    put(spark, path, "old", (NOW, name(1)))
    with monkeypatch.context() as patch, pytest.raises(OSError):
        where = store if step == "_write" else traces
        patch.setattr(where, step, lambda *a, **k: (_ for _ in ()).throw(OSError()))
        put(spark, path, "new", (NOW - DAY, name(1)))
    stored = read_logs(spark, path).where("trace_id = 'x' OR load_id = 'new'").count()
    assert len(found(spark, path, name(1))) == 1 + stored  # rows that are there are found
    put(spark, path, "new", (NOW - DAY, name(1)))
    assert found(spark, path, name(1)) == ["new 0", "old 0"]


def test_tables_from_before_the_index_are_read_whole_until_it_is_built(spark, tmp_path):
    path = str(tmp_path / "logs")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(traces, "begin", lambda *a: False)
        put(spark, path, "old", (NOW, name(1)), (NOW - DAY, name(2)))
    put(spark, path, "next", (NOW - 2 * DAY, name(1)))
    assert not traces.is_indexed(spark, path) and found(spark, path, name(1)) == ["next 0", "old 0"]
    traces.rebuild(spark, path)
    assert days_read(read_trace_logs(spark, path, name(2))) == {"2024-01-30"}
    put(spark, path, "last", (NOW - 3 * DAY, name(2)))
    assert found(spark, path, name(2)) == ["last 0", "old 1"]


def test_expired_days_leave_the_index_at_the_next_compaction(spark, tmp_path):
    path = str(tmp_path / "logs")
    for load in "ab":
        put(spark, path, load, (NOW - 5 * DAY, name(1)), (NOW, name(1)))
    drop_expired_days(spark, path, NOW, days=2)
    assert found(spark, path, name(1)) == ["a 1", "b 1"]
    compact_days(spark, path, NOW + DAY)
    assert traces.trace_days(spark, path, name(1)) == ["2024-01-31"]


def rows_scanned(frame) -> int:
    """Rows that the Parquet scan of the frame handed on, by its own metric."""
    frame._jdf.queryExecution()
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            scans.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
    assert scans
    return sum(scans)


def test_the_trace_filter_skips_row_groups(spark, tmp_path):
    """Ids lie between a file's smallest and largest, so only the filter can tell."""
    path = str(tmp_path / "logs")
    with pytest.MonkeyPatch.context() as patch:
        real = store._write
        patch.setattr(store, "_write", lambda rows, *a: real(rows.repartition(4, "span_id").sortWithinPartitions("ts"), *a))
        rows = [log_row(ts=NOW + i, trace=f"{i * 2654435761 % 2**32:032x}", span=f"{i:016x}") for i in range(4000)]
        append_logs(spark.createDataFrame(rows, LOGS), path, "one")
    assert len(list(Path(path).rglob("day=*/**/*.parquet"))) == 4
    ids = {r.trace_id for r in read_logs(spark, path).collect()}
    there = f"{5 * 2654435761 % 2**32:032x}"
    absent = next(i for i in (f"{n:032x}" for n in range(2**31, 2**32)) if i not in ids)
    look = lambda trace: read_logs(spark, path).where(f"trace_id = '{trace}'").select("body", "trace_id")
    settings = "parquet.filter.dictionary.enabled", "parquet.filter.bloom.enabled"
    try:
        spark.conf.set(settings[0], "false")  # so that only the trace filter is left
        assert 0 < rows_scanned(look(there)) < 4000
        assert rows_scanned(look(absent)) == 0
        spark.conf.set(settings[1], "false")
        assert rows_scanned(look(absent)) == 4000
    finally:
        for setting in settings:
            spark.conf.unset(setting)


@pytest.mark.parametrize("load", ["a=b", "a%b", "eu:1", "x/y", "*", "[a]", "{a,b}", "~41", "compacted", "é ü", "a b", "..", "_x"])
def test_replays_of_any_load_id_replace_it(spark, tmp_path, load):
    path = str(tmp_path / "logs")
    put(spark, path, "other", (NOW - DAY, name(9)))
    put(spark, path, load, (NOW - DAY, name(1)), (NOW, name(2)), (NOW, name(3)))
    put(spark, path, load, (NOW - DAY, name(4)))
    assert sorted(r.trace_id for r in read_logs(spark, path).collect()) == [name(4), name(9)]
    compact_days(spark, path, NOW)
    put(spark, path, load, (NOW, name(5)))
    assert sorted(r.trace_id for r in read_logs(spark, path).collect()) == [name(5), name(9)]
    assert len(found(spark, path, name(5))) == 1


def test_folder_names_differ_where_ids_do():
    ids = ["a", "~61", "compacted", "~63ompacted", "a=b", "a~3Db", "A", "é"]
    assert len({folder_name(i) for i in ids}) == len(ids)
    with pytest.raises(ValueError):
        folder_name("")


def test_storing_a_fresh_load_opens_no_list(spark, tmp_path, monkeypatch):
    path, opened = str(tmp_path / "logs"), []
    for load in "abc":
        put(spark, path, load, *[(NOW - d * DAY, name(d)) for d in range(6)])
    compact_days(spark, path, NOW + DAY)
    real = store.read_text
    monkeypatch.setattr(store, "read_text", lambda *a: opened.append(a[1]) or real(*a))
    put(spark, path, "new", (NOW, name(1)), fresh=True, index=False)
    assert opened == []
    put(spark, path, "new", (NOW, name(1)))
    assert len(opened) == 6
