"""Byte-level BPE: text to token ids and back, by a segment tree of pair ranks.

Each match of the split pattern is merged on its own.  The leaves of a segment
tree are the byte positions of a piece; the leaf of a live position holds the
rank of the pair that starts there, packed with the position, so the minimum of
a node is the lowest rank and, among equals, the leftmost.  A merge reads the
root, joins the two live neighbours and updates three leaves and their paths:
the merged one, its left neighbour's, and the one that dies.  Many pieces of
one batch run side by side, one row of the arrays each; the updates of a step
are the same logarithmic path in every row.

Cases: a null text is empty; an empty text has no tokens and empty bytes; a
piece that is a token itself is that token; a long piece (over 256 bytes) has
a tree of its own.  Rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from deskgauge.llm import common

_POSITION_BITS = 32
_NONE = np.int64(2**62)
_ROWS = 8192
_WIDEST = 256


class Vocabulary:
    """Ranks of byte strings, their pairs, and the split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = np.int64(max(ranks.values()) + 1)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.width) + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair; no entry: ``_NONE``."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Vocabulary:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return Vocabulary(ranks, pattern)


def merge_one(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Tokens of one piece, with one tree."""
    if piece in vocab.ranks:
        return [vocab.ranks[piece]]
    n = len(piece)
    leaves = 1 << max(1, (n - 1).bit_length())
    none, width, pairs = int(_NONE), int(vocab.width), vocab.pairs
    token = vocab.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    tree = [none] * (2 * leaves)

    def packed(at: int) -> int:
        if right[at] >= n:
            return none
        rank = pairs.get(token[at] * width + token[right[at]])
        return none if rank is None else (rank << _POSITION_BITS) | at

    def put(at: int, value: int) -> None:
        node = at + leaves
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    for at in range(n):
        tree[at + leaves] = packed(at)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] != none:
        rank, at = tree[1] >> _POSITION_BITS, tree[1] & (2**_POSITION_BITS - 1)
        gone = right[at]
        token[at], right[at] = rank, right[gone]
        if right[gone] < n:
            left[right[gone]] = at
        put(gone, none)
        put(at, packed(at))
        if left[at] >= 0:
            put(left[at], packed(left[at]))
    ids, at = [], 0
    while at < n:
        ids.append(token[at])
        at = right[at]
    return ids


def merge_rows(pieces: Sequence[bytes], leaves: int, vocab: Vocabulary) -> list[bytes]:
    """Joined ids of pieces of 2 to ``leaves`` bytes, one row of trees each."""
    rows = len(pieces)
    length = np.fromiter(map(len, pieces), np.int64, rows)
    raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8)
    token = vocab.byte_rank[raw].reshape(rows, leaves)
    # One column more: the end of a piece has a place of its own.
    token = np.concatenate([token, np.zeros((rows, 1), np.int64)], axis=1)
    column = np.arange(leaves, dtype=np.int64)
    right = np.tile(column + 1, (rows, 1))
    left = np.tile(column - 1, (rows, 1))
    left = np.concatenate([left, np.zeros((rows, 1), np.int64)], axis=1)
    tree = np.full((rows, 2 * leaves), _NONE)
    live = column[None, :] < (length - 1)[:, None]
    rank = vocab.merged(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(rows, leaves)
    tree[:, leaves:] = np.where(live & (rank != _NONE), (rank << _POSITION_BITS) | column, _NONE)
    width = leaves // 2
    while width:
        tree[:, width:2 * width] = np.minimum(
            tree[:, 2 * width:4 * width:2], tree[:, 2 * width + 1:4 * width:2])
        width //= 2

    def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + leaves
        tree[row, node] = value
        for _ in range(leaves.bit_length() - 1):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def packed(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        other = right[row, at]
        inside = other < length[row]
        rank = vocab.merged(token[row, at], token[row, np.where(inside, other, leaves)])
        return np.where(inside & (rank != _NONE), (rank << _POSITION_BITS) | at, _NONE)

    row = np.flatnonzero(tree[:, 1] != _NONE)
    while len(row):
        least = tree[row, 1]
        at = least & (2**_POSITION_BITS - 1)
        gone = right[row, at]
        after = right[row, gone]
        token[row, at] = least >> _POSITION_BITS
        right[row, at] = after
        left[row, after] = at  # the column past the end takes it harmlessly
        put(row, gone, np.full(len(row), _NONE))
        put(row, at, packed(row, at))
        before = left[row, at]
        has = before >= 0
        put(row[has], before[has], packed(row[has], before[has]))
        row = row[tree[row, 1] != _NONE]
    alive = np.zeros((rows, leaves + 1), bool)
    at, row = np.zeros(rows, np.int64), np.arange(rows)
    while len(row):
        alive[row, at] = True
        at = right[row, at]
        inside = at < length[row]
        row, at = row[inside], at[inside]
    ids = token[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1) * 4).tolist()
    return [ids[start:end] for start, end in zip([0, *ends[:-1]], ends)]


def merge_pieces(pieces: Sequence[str], vocab: Vocabulary) -> dict[str, bytes]:
    """Joined little-endian 32-bit ids of every distinct piece."""
    out: dict[str, bytes] = {}
    by_size: dict[int, list[str]] = {}
    for piece in pieces:
        raw = piece.encode()
        known = vocab.ranks.get(raw)
        if known is not None:
            out[piece] = known.to_bytes(4, "little")
        elif len(raw) > _WIDEST:
            out[piece] = np.array(merge_one(raw, vocab), "<u4").tobytes()
        else:
            by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append(piece)
    for leaves, group in by_size.items():
        step = max(1, _ROWS * 16 // leaves)
        for start in range(0, len(group), step):
            part = group[start:start + step]
            out.update(zip(part, merge_rows([p.encode() for p in part], leaves, vocab)))
    return out


class Encoder:
    """Encodes texts; keeps the tokens of recent pieces, up to a fixed number."""

    def __init__(self, vocab: Vocabulary, remembered: int = 600_000):
        self.vocab, self.remembered = vocab, remembered
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, joined."""
        split = self.vocab.split.findall
        if len(self.known) > self.remembered:
            self.known = {}
        block: list[list[str]] = []
        size = 0
        for text in texts:
            block.append(split(text))
            size += len(block[-1])
            if size > 2_000_000:
                yield from self._joined(block)
                block, size = [], 0
        yield from self._joined(block)

    def _joined(self, block: list[list[str]]) -> Iterator[bytes]:
        new = set().union(*block).difference(self.known)
        self.known.update(merge_pieces(list(new), self.vocab))
        get = self.known.__getitem__
        for pieces in block:
            yield b"".join(map(get, pieces))


def decode(ids: bytes, vocab: Vocabulary) -> bytes:
    """Bytes of little-endian 32-bit ids."""
    return b"".join(map(vocab.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


SCHEMA = "doc_id bigint, ids array<int>, decoded binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _encoded(docs: DataFrame, path: str, pattern: str, schema: str, columns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path, pattern)
        encoder = Encoder(vocab)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                texts = (t or "" for t in part.column(1).to_pylist())
                ids = list(encoder.encode(list(texts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns(ids, vocab)],
                    [f.split()[0] for f in schema.split(", ")])

    return common.documents(docs).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of every text, and the bytes they decode to."""
    def columns(ids, vocab):
        arrays = [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]
        return [pa.array(arrays, pa.list_(pa.int32())),
                pa.array([decode(i, vocab) for i in ids], pa.binary())]

    return _encoded(docs, path, pattern, SCHEMA, columns)


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every text."""
    def columns(ids, vocab):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([sha(i) for i in ids], pa.string()),
                pa.array([sha(decode(i, vocab)) for i in ids], pa.string())]

    return _encoded(docs, path, pattern, DIGESTS, columns)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Text of rows with ``doc_id`` and ``ids``; null ids give empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path, pattern)
        for batch in batches:
            texts = [b"".join(vocab.bytes_of[i] for i in ids or ()).decode("utf-8", "replace")
                     for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, "doc_id bigint, text string")
