"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomlog.session import scratch_path

#: Megabytes of a batch of texts: Spark and its Python worker each hold one several times over.
TEXTS_MB = 2


def stored(frame: DataFrame, label: str) -> DataFrame:
    """`frame` written to the cluster's shared scratch folder and read again.

    Cuts the lineage: what reads the result survives lost executors and never
    repeats the work behind it. The folder stays; an old one may be removed
    when no query reads it any more.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves `remainder`; a null id counts as ''."""
    digits = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(digits.cast("binary")) % modulus == remainder


def in_bytes(frame: DataFrame, megabytes: int = 16) -> DataFrame:
    """`frame`, to be handed to Python in Arrow batches of about so many megabytes.

    Texts differ a thousandfold in length: a number of rows bounds no memory.
    """
    conf = frame.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    return frame


def hand_back() -> None:
    """Give memory that this Python process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries do it by themselves
    if trim:
        trim(0)


def handing_back(per_task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`per_task`, after which its worker hands freed memory back to the system.

    Spark keeps the workers for later tasks: what they held on to would stand beside the
    executor in every later stage, also in those that run no Python.
    """

    def task(batches: Iterator) -> Iterator:
        yield from per_task(batches)
        hand_back()

    return task


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


FLAT = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


def arrow_rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows of flat columns as one batch; works inside tasks, where no session is."""
    fields = [pa.field(name, FLAT[kind]) for name, kind in (c.split() for c in ddl.split(", "))]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def few_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A frame of a few rows that the driver holds. They go as Arrow: as Python objects they
    would start Python workers of another kind in every executor, which stay."""
    return spark.createDataFrame(pa.Table.from_batches([arrow_rows(rows, ddl)]))


def map_texts(
    docs: DataFrame, keep: str, make: Callable[[], Callable[[list[str | None]], Iterable[tuple]]], new: str
) -> DataFrame:
    """Columns `keep` of `docs` (DDL) and the columns `new` (DDL) computed from `text`.

    `make` is called once in each task and gives the function from a batch's texts
    to its rows. What is kept goes through as Arrow, so that ids beside nulls stay whole.
    """
    schema, kept = arrow_schema(f"{keep}, {new}"), [c.split()[0] for c in keep.split(", ")]
    added = schema.names[len(kept) :]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            rows = list(compute(batch.column("text").to_pylist()))
            columns = [batch.column(c).cast(schema.field(c).type) for c in kept]
            columns += [pa.array([r[i] for r in rows], schema.field(c).type) for i, c in enumerate(added)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    texts = in_bytes(docs.select(*dict.fromkeys([*kept, "text"])), TEXTS_MB)
    return texts.mapInArrow(handing_back(per_task), f"{keep}, {new}")
