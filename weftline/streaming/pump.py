"""A bounded pump: rows arrive in micro-batches of at most so many files, a topology's state is kept
by key between them, and every row leaves with its output, in the order of its key.

Keys are dealt to buckets, and rows travel to their bucket's task in slices, as Arrow columns: a call, a read and a
write of the state store serve a bucket's keys at once.  The store holds states by their types, cell by cell (see
state).  Files must be listed in the order of the rows; rows of one micro-batch are sorted here, and those of one
bucket in one micro-batch are held in memory, so a batch's rows bound it.  Inputs, outputs and states are what a
scan's steps see: structs as tuples, nulls as None.
"""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.ports import given, taken
from ..operators.cell import Cell, Drive, fresh
from ..operators.compose import DriveTry
from ..operators.contract import ContractError, validate_capacity
from ..sources.tables import shared_folder
from .state import Bucket, hashed

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys of one stream are dealt to so many buckets.
BUCKETS = 1024
#: Rows travel in slices of at most about so many bytes or rows, and leave in slices of at most so many rows.
SLICE_BYTES, SLICE_ROWS, MADE_ROWS = 64 << 20, 1 << 18, 1000
#: A state of more characters and entries is kept apart from its bucket's (see state).
SMALL = 4096


def _place(value) -> tuple:
    """Sorts as Spark does: nulls first, NaN last."""
    if isinstance(value, float) and value != value:
        return (2,)
    return (0,) if value is None else (1, tuple(map(_place, value)) if isinstance(value, tuple | list) else value)


def _known(kind: T.DataType, c: Column) -> Column:
    """A key as whole numbers and texts, equal for equal keys: what the store gives back as it was."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_known(f.dataType, c[f.name]).alias(f"f{i}") for i, f in enumerate(kind.fields))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _known(kind.elementType, e))
    if isinstance(kind, T.IntegralType | T.StringType):
        return c
    if isinstance(kind, T.FractionalType):
        return (c + F.lit(0.0)).cast("string") if not isinstance(kind, T.DecimalType) else c.cast("string")
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _written(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rows): a task's rows by bucket, in slices."""

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        buckets = rows.column("bucket").to_numpy()
        at = np.argsort(buckets, kind="stable")
        rows, buckets = rows.drop_columns(["bucket"]).take(pa.array(at)).combine_chunks(), buckets[at]
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
        slices, size = [], 0
        for low, high in itertools.pairwise(cuts):
            slices.append((buckets[low], _written(rows.slice(low, high - low))))
            size += len(slices[-1][1])
            if size > SLICE_BYTES // 8 or high == len(buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in slices], pa.int32()), pa.array([r for _, r in slices], pa.binary())], ["bucket", "rows"])
                slices, size = [], 0

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.nbytes for h in held) >= SLICE_BYTES or sum(h.num_rows for h in held) >= SLICE_ROWS:
            yield from dealt(held)
            held = []
    if held:
        yield from dealt(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way back."""
    for b in batches:
        for rows in b.column(0):
            yield from pa.ipc.open_stream(rows.as_buffer())


def _in_order(tables: list[pa.Table], order: list[tuple[str, T.DataType]]) -> np.ndarray:
    """The rows of all tables, by their places there, as Spark sorts them."""
    both, by = pa.concat_tables([t.select(dict.fromkeys(n for n, _ in order)) for t in tables]), {}
    if all(isinstance(kind, T.NumericType | T.BooleanType | T.StringType | T.BinaryType | T.DatetimeType) for _, kind in order):
        for n, kind in order:
            if isinstance(kind, T.FloatType | T.DoubleType):
                by[f"{n} nan"] = pc.fill_null(pc.is_nan(both.column(n)), False).cast(pa.int8())
            by[n] = both.column(n).cast(pa.int8()) if isinstance(kind, T.BooleanType) else both.column(n)
        return pc.sort_indices(pa.table(by), sort_keys=[(n, "ascending") for n in by], null_placement="at_start").to_numpy().astype(np.int64)
    places = list(zip(*(map(_place, taken(kind, both.column(n))) for n, kind in order), strict=True))
    return np.array(sorted(range(len(places)), key=places.__getitem__), dtype=np.int64)


def _at(tables: list[pa.Table], places: np.ndarray) -> pa.Table:
    """Some rows of all tables, which together may be more than one column can hold."""
    ends = np.cumsum([t.num_rows for t in tables])
    which, parts, back, n = np.searchsorted(ends, places, side="right"), [], np.empty(len(places), np.int64), 0
    for i in np.unique(which):
        here = np.flatnonzero(which == i)
        parts.append(tables[i].take(pa.array(places[here] - (ends[i] - tables[i].num_rows))))
        back[here] = np.arange(n, n + len(here))
        n += len(here)
    return (parts[0] if len(parts) == 1 else pa.concat_tables(parts).take(pa.array(back))).combine_chunks()


class _Step(StatefulProcessor):
    """Slices of a bucket's rows to the same rows, in order, with outputs.  Columns have plain names: ``kept`` leave,
    ``keys`` (with their types) tell states apart."""

    def __init__(self, cell: Cell, x: str, kept: list[str], keys: dict[str, T.DataType], order: list[tuple[str, T.DataType]], small: int):
        self.cell, self.x, self.kept, self.keys, self.order, self.small = cell, x, kept, keys, order, small

    def init(self, handle) -> None:
        self.bucket = Bucket(handle, self.cell, T.StructType([T.StructField(n, kind) for n, kind in self.keys.items()]), self.small)
        self.hashed = [(n, kind, hashed(kind)) for n, kind in self.keys.items()]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        tables = [pa.ipc.open_stream(r).read_all() for frame in rows for r in frame["rows"]]
        bucket, step = self.bucket, self.cell.python
        bucket.load()
        live, places = bucket.live, _in_order(tables, self.order)
        for low in range(0, len(places), MADE_ROWS):
            part, made = _at(tables, places[low : low + MADE_ROWS]), []
            keys = zip(*(map(h, taken(kind, part.column(n))) for n, kind, h in self.hashed), strict=True)
            for k, x in zip(keys, taken(self.cell.in_type, part.column(self.x)), strict=True):
                state = live[k] if k in live else bucket.get(k)
                live[k], o = step(state, x)
                made.append(o)
            part = part.select(self.kept).append_column("out", given(self.cell.out_type, made))
            yield pd.DataFrame({"rows": [_written(part)]})
        bucket.save()

    def close(self) -> None:
        pass


def pump(stream: DataFrame, cell: Cell, x: str, out: str, keys: list[str], order: list[str], buckets: int = BUCKETS, small: int = SMALL) -> DataFrame:
    """The stream with the cell's output for each row; a projection for a cell without state.  A checkpoint is
    taken up with the same number of buckets."""
    if not cell.scannable:
        raise ContractError("this cell has no form for streams")
    names = [n for n in stream.columns if n != out]
    if cell.stateless:
        return cell.apply(stream, x, out, Drive()).select(*names, out)
    validate_capacity(buckets)
    # names that Python can't have get numbers
    short = {n: f"c{i}" for i, n in enumerate(dict.fromkeys([*names, *keys, x, *order]))}
    slim = stream.select(F.pmod(F.hash(*keys), F.lit(buckets)).cast("int").alias("bucket"), *(F.col(n).alias(c) for n, c in short.items()), *(_known(stream.schema[k].dataType, F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)))
    schema = T.StructType([*(slim.schema[short[n]] for n in names), T.StructField("out", cell.out_type)])
    step = _Step(cell, short[x], [short[n] for n in names], {f"k{i}": slim.schema[f"k{i}"].dataType for i in range(len(keys))}, [(short[n], stream.schema[n].dataType) for n in order], small)
    dealt = slim.repartition("bucket").mapInArrow(_sliced, "bucket int, rows binary").groupBy("bucket")
    made = dealt.transformWithStateInPandas(step, "rows binary", "append", "none").mapInArrow(_rows, schema)
    return made.select(*(F.col(short[n]).alias(n) for n in names), F.col("out").alias(out))


@contextmanager
def typed_state(spark: SparkSession):
    """The state store that typed state needs, for queries that start in here."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def file_stream(spark: SparkSession, source: str, schema: T.StructType, files_a_batch: int = 1) -> DataFrame:
    validate_capacity(files_a_batch)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)


def bounded_pump(spark: SparkSession, source: str, schema: T.StructType, cell: Cell, x: str, out: str, keys: list[str], order: list[str], files_a_batch: int = 1) -> DataFrame:
    """Run the stream over all files below source and read back what it wrote."""
    target = shared_folder(spark)
    pumped = pump(file_stream(spark, source, schema, files_a_batch), cell, x, out, keys, order)
    with typed_state(spark):
        query = pumped.writeStream.format("parquet").option("path", f"{target}/rows").option("checkpointLocation", f"{target}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(pumped.schema).parquet(f"{target}/rows")


def log_sink(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that writes each micro-batch below ``folder``, in a folder that its number names.  A batch that is
    run again, after a failure at any point, replaces its own rows: each row is there once."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    with typed_state(stream.sparkSession):
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def bounded_pump_try(spark: SparkSession, source: str, schema: T.StructType, a: Cell, b: Cell, x: str, out: str, keys: list[str], order: list[str], files_a_batch: int = 1) -> tuple[DataFrame, DataFrame]:
    """A pump whose first step can fail: the rows that did not, with b's output, and one row with the number
    that did.  The stream runs once; both are read from what it wrote."""
    res = fresh()
    rows = bounded_pump(spark, source, schema, DriveTry(a, b), x, res, keys, order, files_a_batch)
    good = rows.where(F.col(res)["err"].isNull()).withColumn(out, F.col(res)["ok"]).drop(res)
    return good, rows.agg(F.count(F.when(F.col(res)["err"].isNotNull(), 1)).alias("errors"))


def ordered_files(df: DataFrame, order: list[str], folder: str, rows_a_file: int = 1_000_000, least: int = 8) -> None:
    """Write df in ranges of its order, at least ``least``, in files of at most ``rows_a_file`` rows (ranges are of ten
    elevenths of that on average, as they differ: few are cut in two), and date the files in that order, which is how a stream lists them: with a file a batch, no more rows than that are in flight.  The
    folder's store must keep times that are set."""
    validate_capacity(rows_a_file)
    ranges = max(least, -(-df.count() * 11 // (rows_a_file * 10)))
    df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_a_file).parquet(folder)
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    numbered = ((re.match(r"part-(\d+)-.*-c(\d+)\.", str(f.getPath().getName())), f) for f in store.listStatus(path))
    found = sorted(((int(m[1]), int(m[2]), f) for m, f in numbered if m), key=lambda x: x[:2])
    first = int(time.time() * 1000) - 1000 * len(found)
    for i, (_, _, f) in enumerate(found):
        store.setTimes(f.getPath(), first + 1000 * i, -1)
