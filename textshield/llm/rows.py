"""Helpers that the operators share: row identity, pass-through of other columns, samples of labelled rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield import runtime


def release(collect: bool = True) -> None:
    """Give memory that a task no longer uses back to the system: workers live on, beside the next stage's heap."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet (names are compared without case)."""
    taken, name = {c.lower() for c in df.columns}, wanted
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table itself if its rows come straight from files, else as written to the path, or to the shared folder.

    Only rows of files have a place that is the same in every pass, whatever columns a pass reads.
    """
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        if path is None:
            return runtime.written(df, "settled")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return df


def with_locator(df: DataFrame, name: str) -> DataFrame:
    """Add where a row's content is, of a settled table: its file and its place there."""
    return df.withColumn(name, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))


def appended(df: DataFrame, add: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], *, keep: list[str] | None = None) -> DataFrame:
    """The table with columns made batch by batch; a table's own column of such a name gives way.

    make() is called once per task and returns the function that makes the new columns of a batch.
    """
    names = {f.name.lower() for f in add}
    rest = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([*(df.schema[c] for c in rest), *add])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                made = each(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, *(f.name for f in add)])
        del each
        release()

    return df.mapInArrow(run, schema)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a settled table whose place is not among those dropped (one column); columns stay, whatever they are called."""
    mark = free_name(docs, "locator")
    gone = free_name(docs, f"{mark}_dropped")
    return with_locator(docs, mark).join(runtime.if_small(dropped.toDF(gone)), F.col(mark) == F.col(gone), "left_anti").drop(mark)


def filtered(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows that a function, made once per task, says yes to, batch by batch; all columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(each(batch), pa.bool_()))
        del each
        release()

    return df.mapInArrow(run, df.schema)


#: Labels whose shares are sent to every task; of more labels, rows are joined with them.
LABELS_SENT = 10_000


def labelled_sample(docs: DataFrame, label: str, key: str, per_label: int, text: str = "text") -> DataFrame:
    """About per_label rows of each label at most, chosen by a hash of key and text; rows that share both go together.

    One pass over the label column counts; each label then keeps the hashes below per_label / count.
    """
    of, below = free_name(docs, "__of_label"), free_name(docs, "__of_below")
    counts = docs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias(of)).agg(F.count(F.lit(1)).alias(below))
    shares = counts.select(of, (F.least(F.lit(1.0), F.lit(float(per_label)) / F.col(below)) * F.lit(float(1 << 31))).cast("long").alias(below))
    few = shares.take(LABELS_SENT + 1)
    if len(few) <= LABELS_SENT:
        shares = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in few], shares.schema))
    point = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("sample")), F.lit(1 << 31))
    return docs.join(shares, F.col(label) == F.col(of)).where(point < F.col(below)).drop(of, below)


def texts(column: pa.Array) -> list[str]:
    """A text column as a list, null as empty."""
    return [x or "" for x in column.to_pylist()]


#: Bytes of text that are split or counted at once; a longer text makes a slice of its own.
SLICE = 2 << 20


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """A text column in runs of rows of bounded size."""
    ends = np.cumsum(np.concatenate([[0], pc.binary_length(column).fill_null(0).to_numpy()]), dtype=np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield column.slice(at, end - at)
        at = end


def raw(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
