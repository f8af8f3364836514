"""The standard export JSON (OTLP/JSON) as export batches.

Spark's reader parses the lines by a declared schema; a nested value of whatever depth
stays as its raw text. A batch then goes through Arrow once: a column of nested lists is
there a flat array of its innermost values with offsets, so names, numbers, ids and trees
of all requests of a batch are converted flat, without a loop over requests, resources or
records, and the lists are put around them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.trees import bytes_of, nested_text
from ..schema import LANDED_BATCHES

LONGEST = 2**63 - 1
#: The six names of severities, each with three finer ones.
SEVERITIES = [
    f"SEVERITY_NUMBER_{name}{step}"
    for name in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
    for step in ("", "2", "3", "4")
]


def _struct(**fields: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType() if t == "text" else t) for n, t in fields.items()])


# Numbers and ids are read as text: the standard writes 64-bit numbers as strings.
VALUE = _struct(
    stringValue="text", boolValue=T.BooleanType(), intValue="text", doubleValue="text",
    bytesValue="text", arrayValue="text", kvlistValue="text",
)
ATTRIBUTES = T.ArrayType(_struct(key="text", value=VALUE))
RECORD = _struct(
    timeUnixNano="text", observedTimeUnixNano="text", severityNumber="text", severityText="text",
    traceId="text", spanId="text", body=VALUE, attributes=ATTRIBUTES,
)
RESOURCE_LOGS = T.ArrayType(
    _struct(
        resource=_struct(attributes=ATTRIBUTES),
        scopeLogs=T.ArrayType(_struct(logRecords=T.ArrayType(RECORD))),
    )
)
#: A line: the payload, and what the receiver may have written beside it.
STANDARD_BATCHES = T.StructType(
    [f for f in LANDED_BATCHES.fields if f.name != "resource_logs"] + [T.StructField("resourceLogs", RESOURCE_LOGS)]
)


def _each(array: pa.Array, convert: Callable, kind: pa.DataType) -> pa.Array:
    """`convert` of every value that is there; what it cannot read is null."""
    out = []
    for text in array.to_pylist():
        try:
            out.append(None if text is None else convert(text))
        except (ValueError, OverflowError):
            out.append(None)
    return pa.array(out, kind)


def _numbers(array: pa.Array, kind: pa.DataType, convert: Callable) -> pa.Array:
    try:
        return pc.cast(array, kind)
    except pa.ArrowInvalid:  # a number beyond the type, or no number: one by one
        return _each(array, convert, kind)


def _stamp(text: str) -> int:
    return max(0, min(int(text), LONGEST))


def _severity(text: str) -> int:
    return SEVERITIES.index(text) + 1 if text in SEVERITIES else int(text)


def _list(array: pa.ListArray, convert: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The list with its values converted; one not at its buffer's start is copied first."""
    if array.offset:
        array = pa.concat_arrays([array])
    return pa.ListArray.from_arrays(array.offsets, convert(array.values), mask=array.is_null())


def _fields(array: pa.StructArray, **children: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(children.values()), list(children), mask=array.is_null())


def _nested(array: pa.StructArray) -> pa.Array:
    lists, maps = array.field("arrayValue"), array.field("kvlistValue")
    if lists.null_count == len(array) == maps.null_count:
        return pa.nulls(len(array), pa.string())
    out: list[str | None] = [None] * len(array)
    for kind, texts in (("arrayValue", lists), ("kvlistValue", maps)):
        for i in pc.indices_nonzero(texts.is_valid()).to_pylist():
            out[i] = nested_text(kind, texts[i].as_py())
    return pa.array(out, pa.string())


def _value(array: pa.StructArray) -> pa.Array:
    return _fields(
        array,
        string_value=array.field("stringValue"),
        bool_value=array.field("boolValue"),
        int_value=_numbers(array.field("intValue"), pa.int64(), int),
        double_value=_numbers(array.field("doubleValue"), pa.float64(), float),
        bytes_value=_each(array.field("bytesValue"), bytes_of, pa.binary()),
        json_value=_nested(array),
    )


def _pairs(array: pa.ListArray) -> pa.Array:
    return _list(array, lambda p: _fields(p, key=p.field("key"), value=_value(p.field("value"))))


def _record(array: pa.StructArray) -> pa.Array:
    return _fields(
        array,
        time_unix_nano=_numbers(array.field("timeUnixNano"), pa.int64(), _stamp),
        observed_time_unix_nano=_numbers(array.field("observedTimeUnixNano"), pa.int64(), _stamp),
        severity_number=_numbers(array.field("severityNumber"), pa.int32(), _severity),
        severity_text=array.field("severityText"),
        trace_id=_each(array.field("traceId"), bytes.fromhex, pa.binary()),
        span_id=_each(array.field("spanId"), bytes.fromhex, pa.binary()),
        body=_value(array.field("body")),
        attributes=_pairs(array.field("attributes")),
    )


def _resource(array: pa.StructArray) -> pa.Array:
    own = array.field("resource")
    return _fields(
        array,
        resource=_fields(own, attributes=_pairs(own.field("attributes"))),
        scope_logs=_list(
            array.field("scopeLogs"),
            lambda s: _fields(s, log_records=_list(s.field("logRecords"), _record)),
        ),
    )


def as_export_batches(requests: DataFrame) -> DataFrame:
    """Requests with `resourceLogs` as read, to the same with `resource_logs` as the
    mapping takes it; other columns pass as they are.

    An id that is not hexadecimal is dropped, as one of a wrong length is; a time beyond
    64 bits is the latest there is; a number that cannot be read counts as not given.
    """
    rest = [f for f in requests.schema.fields if f.name != "resourceLogs"]
    landed = next(f for f in LANDED_BATCHES.fields if f.name == "resource_logs")
    schema = T.StructType([*rest, landed])
    arrow = to_arrow_schema(schema)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f.name) for f in rest]
            payload = _list(batch.column("resourceLogs"), _resource)
            columns.append(payload.cast(arrow.field("resource_logs").type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return requests.select(*[f.name for f in rest], "resourceLogs").mapInArrow(convert, schema)
