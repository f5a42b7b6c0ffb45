"""Token counts of a byte-level BPE vocabulary by a finite-state transducer.

Two machines run in turn. The pre-tokenising transducer (pretok.py) is composed over chunks of text
by a parallel prefix scan. Each of its slices then runs through a deterministic transducer over
bytes whose transitions carry the number of tokens by which the count changes.

A state of the second machine is what the future can depend on: for each earlier position from
which some vocabulary entry can still be completed, the trie node reached, the last token before
it and its count against the current one. The last token of a prefix's encoding is the one entry
that ends there and stands next to the entry before it, unmerged, when both are encoded alone.
States and transitions are compiled when first met and dropped together beyond a fixed number,
so memory is bounded and results do not depend on it.

Defined results: null and empty texts count 0; the vocabulary's special strings inside a text count
one token and split it, as the library does by default; extra columns are ignored; repeated rows
give repeated results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import pretok
from sparkloom.llm.common import bounded, column, strings, table

MAX_STATES = 200_000


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Ranks of the entries (their merge order) and the special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec.get("added_tokens", [])]
    as_byte = byte_characters()
    ranks = {bytes(as_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return ranks, special


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """Byte-pair merging of a short piece by ranks under a bound: lowest first, leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    costs = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
    while costs and (best := min(costs)) < below:
        at = costs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del costs[at]
        if at:
            costs[at - 1] = ranks.get(parts[at - 1] + parts[at], below)
        if at < len(costs):
            costs[at] = ranks.get(parts[at] + parts[at + 1], below)
    return parts


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each entry of several bytes, the two entries that its last merge joins."""
    out = {}
    for word, rank in ranks.items():
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 1:
            out[rank] = tuple(ranks[x] for x in merge(word, ranks, below=rank))
    return out


class CountTransducer:
    """Deterministic byte transducer whose transitions carry token-count differences."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.child: list[dict[int, int]] = [{}]
        self.entry: list[int | None] = [None]
        self.parts = last_merges(ranks)
        self.joined = {pair: rank for rank, pair in self.parts.items()}
        for word, rank in ranks.items():
            node = 0
            for b in word:
                after = self.child[node].get(b)
                if after is None:
                    after = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.entry.append(None)
                node = after
            self.entry[node] = rank
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self.intern(((0, -1, 0),))

    def intern(self, state: tuple) -> int:
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return at

    def adjacent(self, left: int, right: int) -> bool:
        """Whether right follows left as it is when both are encoded alone.

        Both entries are unfolded along the seam, the later merge first. They would not stay apart
        if, at any time, the two parts that touch merge before the merges that are still to come.
        """
        if left < 0:
            return True
        parts, joined, bound = self.parts, self.joined, 1 << 60
        while True:
            rank = joined.get((left, right))
            if rank is not None and rank < bound:
                return False
            # of equal ranks the leftmost merge comes first, so a part on the right may still be joined at its own rank
            if left > right and left in parts:
                bound, left = left, parts[left][1]
            elif right in parts:
                bound, right = right + 1, parts[right][0]
            elif left in parts:
                bound, left = left, parts[left][1]
            else:
                return True

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state by a byte, with the change of the token count."""
        opened, last, change = [], -1, None
        for node, before, count in self.states[state]:
            after = self.child[node].get(byte)
            if after is None:
                continue
            word = self.entry[after]
            if word is not None and change is None and self.adjacent(before, word):
                last, change = word, count + 1
            opened.append((after, before, count))
        kept = tuple((node, before, count - change) for node, before, count in opened if self.child[node])
        move = self.moves[state][byte] = (self.intern((*kept, (0, last, 0))), change)
        return move

    def count(self, piece: bytes) -> int:
        if len(self.states) > self.max_states:
            self.reset()
        state, total, moves = self.start, 0, self.moves
        for byte in piece:
            step = moves[state].get(byte)
            if step is None:
                if len(self.states) > self.max_states:
                    # states are dropped inside a long slice as well; the one at hand is kept
                    held = self.states[state]
                    self.reset()
                    moves, state = self.moves, self.intern(held)
                step = self.compile(state, byte)
            state, change = step
            total += change
        return total


class SliceCounts(pretok.SliceCache):
    """Token counts of slices."""

    def __init__(self, machine: CountTransducer):
        super().__init__()
        self.machine = machine

    def value(self, piece: bytes) -> int:
        return self.machine.count(piece)


_compiled: dict[str, tuple[SliceCounts, list[str]]] = {}


def compiled(path: str) -> tuple[SliceCounts, list[str]]:
    if path not in _compiled:
        ranks, special = read_vocabulary(path)
        _compiled[path] = SliceCounts(CountTransducer(ranks)), special
    return _compiled[path]


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Token counts of texts; each special string is one token and ends what stands before it."""
    counts, special = compiled(path)
    extra = np.zeros(len(texts), np.int64)
    pieces, owner = texts, None
    if any(s in t for s in special for t in texts):
        pieces, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            for s in special:
                parts = [x for part in parts for x in part.split(s)]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
    joined, starts, stops, per_text = pretok.slices(pieces)
    each = np.fromiter(map(counts.__getitem__, map(joined.__getitem__, map(slice, starts, stops))), np.int64, len(starts))
    sums = np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(per_text)])])
    if owner is not None:
        sums = np.bincount(owner, sums, len(texts)).astype(np.int64)
    return sums + extra


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row: one pass over the rows where they lie, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = strings(column(batch, "text"))
            for a, b in pretok.portions(texts):
                size = [len(x.encode("utf-8", "surrogatepass")) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([column(batch, "key").slice(a, b - a), pa.array(size, pa.int64()), pa.array(count_texts(texts[a:b], path))], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
