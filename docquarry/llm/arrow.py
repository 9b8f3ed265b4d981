"""Small helpers for Arrow tasks: bytes of a text column without copies, and batches from numpy columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value; null is empty."""
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1] if len(large) else [0]
    data = large.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    gone = large.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(large)):
        yield whole[:0] if gone[i] else whole[offsets[i] : offsets[i + 1]]


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def keyed(docs: DataFrame) -> DataFrame:
    """``did`` and ``tag`` name a row's document: its id (null has a place of its own) and a hash of its text,
    so two texts under one id stay apart. Only these and the text go on: clashing extra columns don't matter."""
    return docs.select(id_of(F.col("doc_id")).alias("did"), text_tag(F.col("text")).alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def text_tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def id_back(did: Column) -> Column:
    return F.nullif(did, F.lit(NO_ID))


def fewer(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """One batch of the rows gathered in several tuples of numpy columns."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
