"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of a text's bytes picks chunk ends, moved on to the next white space, so the same passage falls into the same chunks
wherever it stands. Documents are dealt out by their least chunk hash, which brings documents that share passages to
one task, and there each different chunk is encoded once. Where a chunk ends inside a word (text without white space), the join is
repaired: the words at its two sides are encoded anew as one, the ids outside must agree with those of the chunks, and the window grows until
they do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, id_of, longs, texts
from docquarry.llm.hashing import BLOCK, WHITE, Rolling, byte_codes
from docquarry.llm.pieces import between_blanks, encoder, tokenizer

SPAN, MEAN, MOST = 24, 1024, 8192
MEMO_BYTES = 32 << 20


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks: after about MEAN bytes where the hash of the last SPAN bytes says so, at white space if there is
    any within MOST bytes, else at a character's end."""
    n, marks = len(data), []
    for low in range(0, max(0, n - SPAN), BLOCK):
        hashes = Rolling(byte_codes(data[low : low + BLOCK + SPAN - 1])).windows(SPAN)
        marks.append(np.flatnonzero((hashes & np.uint64(MEAN - 1)) == 0) + low + SPAN)
    cuts = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    blank = np.flatnonzero(WHITE[data])
    ends, at = [], 0
    while at < n:
        i = np.searchsorted(cuts, at + SPAN)
        want = int(min(cuts[i] if i < len(cuts) else n, at + MOST))
        j = np.searchsorted(blank, want)
        end = int(blank[j]) if j < len(blank) else n
        if end > at + 2 * MOST:  # no white space: inside a word
            end = want
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
        ends.append(at := max(end, at + 1))
    return ends


def sketch(data: np.ndarray) -> int:
    """The least of the chunks' hashes: documents that share passages tend to share it."""
    least, at = (1 << 63) - 1, 0
    for end in chunk_ends(data):
        least = min(least, int.from_bytes(hashlib.blake2b(data[at:end], digest_size=8).digest(), "little") >> 1)
        at = end
    return least


def _last_word(chunk: bytes) -> bytes:
    at = max(chunk.rfind(x) for x in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    return chunk[at + 1 :]


def _first_word(chunk: bytes) -> bytes:
    found = np.flatnonzero(WHITE[np.frombuffer(chunk, np.uint8)])
    return chunk[: found[0]] if len(found) else chunk


class ChunkEncoder:
    """Ids of texts from chunks that are encoded once while the memo holds them."""

    def __init__(self, path: str) -> None:
        self.coder, self.memo, self.size = encoder(path, between_blanks, "<u4", lower=True), {}, 0

    def _ids(self, chunk: bytes) -> bytes:
        return self.coder.encode([chunk.decode()])[0]

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        new = list({c for c in chunks if c not in self.memo})
        if self.size > MEMO_BYTES:
            self.memo, self.size = {c: self.memo[c] for c in chunks if c in self.memo}, 0
        self.memo.update(zip(new, self.coder.encode([c.decode() for c in new]), strict=True))
        self.size += sum(map(len, new)) * 3
        return [self.memo[c] for c in chunks]

    def encode(self, data: np.ndarray) -> bytes:
        ends, whole = chunk_ends(data), data.tobytes()
        chunks = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]
        ids = self.chunk_ids(chunks)
        parts, i = [], 0
        while i < len(chunks):
            j = i + 1
            while j < len(chunks) and not (WHITE[chunks[j][0]] or WHITE[chunks[j - 1][-1]]):
                j += 1  # a word runs on over this join
            parts.append(ids[i] if j == i + 1 else self._repaired(chunks[i:j], ids[i:j]))
            i = j
        return b"".join(parts)

    def _repaired(self, chunks: list[bytes], ids: list[bytes]) -> bytes:
        """Ids of chunks whose joins fall inside words: those words are encoded whole, between what the chunks agree on."""
        out, word = [], b""
        for k, (chunk, coded) in enumerate(zip(chunks, ids, strict=True)):
            if not WHITE[np.frombuffer(chunk, np.uint8)].any():
                word += chunk
                continue
            head = _first_word(chunk) if k else b""
            tail = _last_word(chunk) if k < len(chunks) - 1 else b""
            before, after = self._ids(head), self._ids(tail)
            if not (coded.startswith(before) and coded.endswith(after)):
                return self._ids(b"".join(chunks))  # no agreement: the window grows to all of them
            out += [self._ids(word + head), coded[len(before) : len(coded) - len(after)]]
            word = tail
        return b"".join(out) + self._ids(word)

def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column(pa.field("sketch", pa.int64()), pa.array([sketch(x) for x in texts(batch["text"])], pa.int64()))


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` (did, text) dealt out by range of what they share, so a group that shares a sketch takes as many tasks as its rows need."""
    rows = docs.mapInArrow(_sketches, "did long, text string, sketch long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "sketch", "did").drop("sketch")


class Decoder:
    """The library's decode, special tokens included. Without a decoder in the file that is the tokens joined by spaces."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())] if self.tokenizer.decoder is None else None

    def decode(self, coded: bytes) -> str:
        ids = np.frombuffer(coded, "<u4").tolist()
        return " ".join(map(self.tokens.__getitem__, ids)) if self.tokens else self.tokenizer.decode(ids, skip_special_tokens=False)


_coders: dict[str, tuple[ChunkEncoder, Decoder]] = {}
_OUT = pa.schema([("did", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _coders:
            _coders[path] = ChunkEncoder(path), Decoder(path)
        coder, decoder = _coders[path]
        for batch in batches:
            rows = []
            for did, data in zip(longs(batch["did"]), texts(batch["text"]), strict=True):
                ids = coder.encode(data)
                text = decoder.decode(ids)
                rows.append({"did": int(did), "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_tokens, ids_sha256, decoded_sha256), as the tokenizers library gives them.

    Null and empty texts have no ids and decode to the empty text; repeated rows each get their row; an empty table gives no rows; other columns are ignored."""
    rows = dealt(docs.select(id_of(F.col("doc_id")).alias("did"), F.coalesce("text", F.lit("")).alias("text")))
    out = rows.mapInArrow(_coded(tokenizer_path), "did long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(id_back(F.col("did")).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
