"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..workspace import checkpointed, discard, scratch, shared_dir  # noqa: F401

#: ASCII white space, the separators of the word contracts.
WHITE = " \t\n\x0b\x0c\r"
#: Rows of a table of a few narrow columns up to which it is sent to every executor.
SEND_ROWS = 1_000_000
#: Rows of texts that are held at once on their way to Python and back.
BATCH_ROWS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def sent(df: DataFrame, most: int = SEND_ROWS) -> DataFrame:
    """df, sent to every executor if it has `most` rows at most; Spark joins it as it sees fit beyond that."""
    return F.broadcast(df) if df.count() <= most else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run inside sends batches of so many rows to Python, so that those of long texts need little memory. The session's own setting is back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function from batches to batches. After each partition its worker, which is kept for later ones, gives freed memory back to the system."""

    def own(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return own


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Words between ASCII white space, as long; null has none."""
    spaced = F.translate(c, WHITE[1:], " " * (len(WHITE) - 1))
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name from `name` that df doesn't have, in any case of its letters."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def added(rows: DataFrame, reads: list[str], results: str, start: Callable[[], Callable[..., list[list]]], block_bytes: int = 0) -> DataFrame:
    """rows with result columns (a DDL string), computed from the columns `reads` batch by batch.

    start() gives, once a partition, a function from lists of values to a list for each result. All columns of
    rows pass by as they are, in Arrow; where rows has a result's name already, the result gets underscores.
    Batches are put together until they have block_bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own = StructType.fromDDL(results)
    own = StructType([StructField(fresh(rows, f.name), f.dataType) for f in own.fields])
    at, kinds, names = [rows.columns.index(c) for c in reads], [to_arrow_type(f.dataType) for f in own.fields], [*rows.columns, *own.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            made = f(*[[x for b in held for x in b.column(k).to_pylist()] for k in at])
            made, first = [pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)], 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, *[x.slice(first, b.num_rows) for x in made]], names=names)
                first += b.num_rows
            held.clear()

        for batch in batches:
            f = f or start()
            for at_row in range(0, batch.num_rows, BATCH_ROWS):  # few texts are Python objects at once
                held.append(batch.slice(at_row, BATCH_ROWS))
                if not block_bytes or sum(b.nbytes for b in held) >= block_bytes:
                    yield from done()
        if held:
            yield from done()

    return rows.mapInArrow(lean(run), StructType([*rows.schema.fields, *own.fields]))
