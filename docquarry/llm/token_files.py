"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, bases from prefix sums.

Part k of a corpus holds a range of doc_ids: ``part-k.ids`` (ids of its documents, one after the other), ``part-k.offsets`` (64-bit
start of each document in the part, and the end) and ``part-k.docs`` (64-bit doc_ids). The parts' counts, summed up in doc_id
order, give each part's base. A reader maps the files and adds the base. Files go to the shared folder; a task writes under a name of its
own and renames, so a task that runs again leaves the same files."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, id_of, longs
from docquarry.llm.pieces import before_words, encoder
from docquarry.session import Scratch

BATCH_CHARS = 2_000_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and the path in it; local paths and file: URIs are a shared mount."""
    local = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(folder)


def _write(path: str, end_id: int, dtype: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        own = f"{base}/.{part}-{uuid.uuid4().hex}"
        coder, end = encoder(path, before_words, dtype, lower=False), np.array([end_id], dtype).tobytes()
        width, offsets, ids = np.dtype(dtype).itemsize, [0], []
        with store.open_output_stream(f"{own}.ids") as out:
            for batch in batches:
                ids.append(longs(batch["did"]))
                texts = [x or "" for x in batch["text"].to_pylist()]
                i = 0
                while i < len(texts):  # so many at a time that a piece's ids stay small
                    j, n = i, 0
                    while j < len(texts) and (j == i or n + len(texts[j]) <= BATCH_CHARS):
                        n += len(texts[j])
                        j += 1
                    for coded in coder.encode(texts[i:j]):
                        out.write(coded + end)
                        offsets.append(offsets[-1] + len(coded) // width + 1)
                    i = j
        docs = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        for name, data in (("offsets", np.array(offsets, "<u8")), ("docs", docs.astype("<i8"))):
            with store.open_output_stream(f"{own}.{name}") as out:
                out.write(data.tobytes())
        for name in ("ids", "offsets", "docs"):
            store.move(f"{own}.{name}", f"{base}/part-{part}.{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(docs)], "tokens": [offsets[-1]]}, schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int) -> DataFrame:
    """Write the files of ``docs`` in doc_id order; one row per part: (part, docs, tokens, base, folder, dtype)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    folder, dtype = f"{scratch.path}/files", "<u2" if vocabulary <= 1 << 16 else "<u4"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(id_of(F.col("doc_id")).alias("did"), "text").repartitionByRange(parts, "did").sortWithinPartitions("did", "text")
    made = scratch.save("parts", rows.mapInArrow(_write(tokenizer_path, end_id, dtype, folder), "part int, docs long, tokens long"))
    base = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")  # a row for each part
    return made.select("part", "docs", "tokens", base.alias("base"), F.lit(folder).alias("folder"), F.lit(dtype).alias("dtype"))


_READ = pa.schema([(n, pa.int64()) for n in ("did", "start", "n_tokens", "ids_crc32")])


def _mapped(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, base = opened(row["folder"])
            ids, offsets, docs = (_mapped(store, f"{base}/part-{row['part']}.{name}", kind) for name, kind in (("ids", row["dtype"]), ("offsets", "<u8"), ("docs", "<i8")))
            crcs = np.array([zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
            starts = offsets.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(docs)), pa.array(starts[:-1] + row["base"]), pa.array(np.diff(starts)), pa.array(crcs)], schema=_READ)


def read_ids(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, as read from them."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = parts.repartition(n, "part").mapInArrow(_read, "did long, start long, n_tokens long, ids_crc32 long")
    return out.select(id_back(F.col("did")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def written_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, vocabulary: int = 50_257) -> DataFrame:
    """Encode, write and read back: (doc_id, start, n_tokens, ids_crc32), with the end id counted.

    Null and empty texts have the end id alone; a null doc_id comes first; repeated ids stand together in the order of their texts; an empty
    table gives no rows; other columns are ignored. Ids take 16 bits where the vocabulary fits."""
    return read_ids(write_ids(docs, tokenizer_path, end_id, vocabulary))
