"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.graph import written as checkpointed  # noqa: F401

#: Words of the shingle and size contracts: runs without blank, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> list[str]:
    """A batch's column as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def fold(df: DataFrame, salt: int, parts: int, key: str = "doc_id") -> tuple:
    """Condition for rows outside the held-out fold: crc32 of the key as text, modulo parts, is not salt."""
    return F.crc32(F.col(key).cast("string")) % parts != salt


def bounded(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have that many bytes at most, or a single row: so a batch of long texts never stands as Python strings at once."""
    for batch in batches:
        col = column(batch, text)
        if pa.types.is_struct(col.type):
            col = col.field(0)
        ends = np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, none longer than so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blank_words(text: str) -> list[str]:
    return re.findall(WORD, text)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column's rows one after another, and where each row starts, with the end; null as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_marks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a word of the size contract starts at each byte."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    marks = ~blank
    marks[1:] &= blank[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    marks[first] = ~blank[first]
    return marks


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between row bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])
