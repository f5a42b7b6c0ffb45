"""Byte-level BPE encoding and decoding: boundaries by transition-function scans, cached pair merging.

pretok.py finds the slices of many texts at once from arrays of codepoint classes. Each slice's
token ids come from a bounded cache of slices merged before. Encodings keep, on request, the byte
offset of every token, and decoding sets each token's vocabulary entry at its offset.

Defined results: null and empty texts give no ids and decode to no bytes; text has no special
strings; extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import pretok
from sparkloom.llm.common import bounded, column, strings, table
from sparkloom.llm.token_counts import merge

#: Pieces of up to so many bytes are merged by plain scans of their pairs, longer ones with a heap.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of lowest rank is merged first, the leftmost among equals. n log n in its length."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= SHORT:
        return [ranks[x] for x in merge(piece, ranks)]
    n = len(piece)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    end = list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        end[i], end[j] = stop, 0
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class SliceIds(pretok.SliceCache):
    """Packed ids of slices."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def value(self, piece: bytes) -> bytes:
        return array("I", merge_ids(piece, self.ranks)).tobytes()


_codecs: dict[str, tuple[SliceIds, np.ndarray, np.ndarray]] = {}


def codec(path: str) -> tuple[SliceIds, np.ndarray, np.ndarray]:
    """Of a rank file: the cache of slices, the bytes of all entries one after another, and where each id's entry starts, with the end."""
    if path not in _codecs:
        ranks = read_ranks(path)
        words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        _codecs[path] = SliceIds(ranks), np.frombuffer(b"".join(words), np.uint8), np.cumsum([0] + [len(w) for w in words])
    return _codecs[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as packed little-endian unsigned 32-bit integers."""
    ids = codec(path)[0]
    joined, starts, stops, per_text = pretok.slices(texts)
    each = list(map(ids.__getitem__, map(joined.__getitem__, map(slice, starts, stops))))
    bounds = np.concatenate([[0], np.cumsum(per_text)]).tolist()
    return [b"".join(each[a:b]) for a, b in zip(bounds, bounds[1:])]


def offsets(packed: bytes, path: str) -> np.ndarray:
    """Byte offset at which each token starts, with the end of the last."""
    starts, ids = codec(path)[2], np.frombuffer(packed, "<u4").astype(np.int64)
    return np.concatenate([[0], np.cumsum(starts[ids + 1] - starts[ids])])


def decode(packed: bytes, path: str, at: np.ndarray | None = None) -> bytes:
    """The bytes of ids: every token's entry at the token's offset, for all tokens at once; offsets are found again where they were not kept."""
    _, entries, starts = codec(path)
    at = offsets(packed, path) if at is None else at
    ids = np.frombuffer(packed, "<u4").astype(np.int64)
    return entries[np.repeat(starts[ids] - at[:-1], np.diff(at)) + np.arange(at[-1])].tobytes()


def encode(docs: DataFrame, path: str, text: str = "text", with_offsets: bool = False) -> DataFrame:
    """The rows with `ids` (array of int) and, if asked for, `offsets` (array of long) in place of columns of those names."""
    return _mapped(docs, path, text, with_offsets)


def _mapped(docs: DataFrame, path: str, text: str, with_offsets: bool) -> DataFrame:
    rest = docs.drop("ids", "offsets")
    packed = rest.select(*rest.columns, F.struct(F.col(text).alias("text")).alias("__text"))
    out = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if with_offsets:
        out = out.add("offsets", T.ArrayType(T.LongType()))
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "__text"):
            texts = strings(column(batch, "__text").field("text"))
            for a, b in pretok.portions(texts):
                coded = encode_texts(texts[a:b], path)
                arrays = [column(batch, c).slice(a, b - a) for c in names]
                values = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(np.cumsum([0] + [len(x) // 4 for x in coded]).astype(np.int32), pa.array(values)))
                if with_offsets:
                    arrays.append(pa.array([offsets(x, path) for x in coded], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, [*names, "ids"] + ["offsets"] * with_offsets)

    return packed.mapInArrow(run, out)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = strings(column(batch, "text"))
            for a, b in pretok.portions(texts):
                coded = encode_texts(texts[a:b], path)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "key").slice(a, b - a),
                        pa.array([len(x) // 4 for x in coded], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                        pa.array([hashlib.sha256(decode(x, path, offsets(x, path))).hexdigest() for x in coded]),
                    ],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
