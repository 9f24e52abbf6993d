"""Byte-level BPE encoding and decoding in padded numpy matrices.

The distinct pre-tokens of a batch are grouped by length into padded matrices.
In each round every row merges its leftmost pair of minimum rank; pair ranks come
from a hashed table, and rows close the gap by compaction. Finished rows leave
the matrix. What has been encoded is remembered per worker process (bounded by
``CACHE_TOKENS``; when full, the memory starts anew), keyed by the 64-bit hash of
the pre-token's bytes and length.

Null and empty texts have no tokens. Repeated rows are encoded alike, each for
itself. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K

#: Pre-tokens remembered per worker.
CACHE_TOKENS = 1 << 19
#: Longer pre-tokens are merged with a heap, since a matrix costs rounds times width.
MATRIX_BYTES = 512
#: Elements of one matrix.
MATRIX_CELLS = 1 << 21

_NO_PAIR = np.int32(2**31 - 1)


class Ranks:
    """A vocabulary of byte strings with merge ranks (the ids)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.size = max(self.rank.values()) + 1
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, made = [], [], []
        for token, rank in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        self._pairs = K.HashIndex(len(made))
        self._pairs.insert(_pair_keys(np.array(left), np.array(right)), np.array(made))
        tokens = [b""] * self.size
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or a large number; negative ids are padding."""
        found = self._pairs.find(_pair_keys(left, right).ravel()).reshape(left.shape)
        return np.where((found < 0) | (left < 0) | (right < 0), _NO_PAIR, found).astype(np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece (a whole pre-token)."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(piece) > MATRIX_BYTES:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge_matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
        ids = np.full((count, width + 1), -1, dtype=np.int32)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids[np.repeat(np.arange(count), lengths), K.expand(np.zeros(count, np.int64), lengths)] = self.byte_rank[flat]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows, columns = np.arange(count), np.arange(width)
        out: list = [None] * count
        while len(rows):
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), best]
            done = least == _NO_PAIR
            if done.any():
                sizes = (ids[done] >= 0).sum(axis=1)
                for row, line, size in zip(rows[done], ids[done], sizes, strict=True):
                    out[row] = line[:size].copy()
                keep = ~done
                rows, ids, ranks, best, least = rows[keep], ids[keep], ranks[keep], best[keep], least[keep]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            ids[at, best] = least
            behind = columns[None, :] > best[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            # the pair that starts at best + 1 has gone with the merge
            shifted = np.full_like(ranks, _NO_PAIR)
            shifted[:, :-1] = ranks[:, 1:]
            ranks = np.where(behind, shifted, ranks)
            ranks[at, best] = self.pair_ranks(ids[at, best], ids[at, best + 1])
            has = np.flatnonzero(best > 0)
            ranks[has, best[has] - 1] = self.pair_ranks(ids[has, best[has] - 1], ids[has, best[has]])
            if len(rows) and width > 8:
                used = int((ids >= 0).sum(axis=1).max())
                if used <= width // 2:
                    width = max(2, used)
                    ids, ranks, columns = ids[:, : width + 1].copy(), ranks[:, :width].copy(), np.arange(width)
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_rank[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r != _NO_PAIR]
        heapq.heapify(heap)
        current = {i: r for r, i in heap}
        rank_of = lambda a, b: int(self.pair_ranks(np.array([a]), np.array([b]))[0])
        known: dict[tuple[int, int], int] = {}
        while heap:
            rank, i = heapq.heappop(heap)
            if current.get(i) != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            current.pop(i, None), current.pop(j, None)
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a < 0 or b >= len(ids):
                    continue
                pair = (ids[a], ids[b])
                if pair not in known:
                    known[pair] = rank_of(*pair)
                if known[pair] == int(_NO_PAIR):
                    current.pop(a, None)
                else:
                    current[a] = known[pair]
                    heapq.heappush(heap, (known[pair], a))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the rows of ids and the rows' offsets into them."""
        lengths = self.lengths[ids]
        raw = self.bytes[K.expand(self.starts[ids], lengths)]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        return raw, ends[first]


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)


class CachedEncoder:
    """Encodes rows of text by their pre-tokens; ``encode_new`` is called for those not yet known."""

    def __init__(self, encode_new: Callable[[list[bytes]], list[np.ndarray]], limit: int = CACHE_TOKENS):
        self._encode_new, self._limit = encode_new, limit
        self._clear()

    def _clear(self) -> None:
        self._index = K.HashIndex(1 << 14)
        self._ids = np.zeros(1 << 16, dtype=np.int32)
        self._starts, self._lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._used = 0

    def rows(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one row after another, and the rows' offsets into them."""
        starts, ends, first = K.pretokens(raw, offs)
        keys = K.RangeHasher(raw)(starts, ends)
        entry = self._index.find(keys)
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            fresh, one = np.unique(keys[unknown], return_index=True)
            if self._index.count and self._index.count + len(fresh) > self._limit:
                self._clear()
                fresh, unknown = np.unique(keys, return_index=True)
                one = np.arange(len(fresh))
            self._add(fresh, raw, starts[unknown[one]], ends[unknown[one]])
            entry = self._index.find(keys)
        lengths = self._lengths[entry]
        ids = self._ids[K.expand(self._starts[entry], lengths)]
        sums = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        return ids, sums[first]

    def _add(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = raw.tobytes()
        made = self._encode_new([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        lengths = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        have, total = self._index.count, int(lengths.sum())
        while have + len(made) > len(self._starts):
            self._starts, self._lengths = np.resize(self._starts, 2 * len(self._starts)), np.resize(self._lengths, 2 * len(self._lengths))
        while self._used + total > len(self._ids):
            self._ids = np.resize(self._ids, 2 * len(self._ids))
        self._ids[self._used : self._used + total] = np.concatenate(made)
        self._lengths[have : have + len(made)] = lengths
        self._starts[have : have + len(made)] = self._used + np.cumsum(lengths) - lengths
        self._used += total
        self._index.insert(keys, np.arange(have, have + len(made)))


_ranks: dict[str, tuple[Ranks, CachedEncoder]] = {}


def tokenizer(path: str) -> tuple[Ranks, CachedEncoder]:
    """The vocabulary of a rank file and its encoder, once per process."""
    if path not in _ranks:
        ranks = Ranks(path)
        _ranks[path] = ranks, CachedEncoder(ranks.merge)
    return _ranks[path]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column if not pa.types.is_null(column.type) else column.cast(pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Adds the ids of ``text`` as an array column (empty for null); other columns stay as they are.

    A column already named ``ids`` is replaced.
    """
    kept = [c for c in df.columns if c != ids]
    if text not in kept:
        raise ValueError(f"no column {text!r}")
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*[f"`{c}`" for c in kept]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = tokenizer(path)
        for batch in batches:
            for a, b, raw, offs in K.slices(_column(batch, text)):
                found, first = encoder.rows(raw, offs)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists], names=[*kept, ids])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, `{ids}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Adds the text of an id column; invalid UTF-8 (ids cut within a character) becomes U+FFFD."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*[f"`{c}`" for c in kept]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _ = tokenizer(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                column = part.column(part.schema.get_field_index(ids))
                column = pa.array(column.to_pylist(), pa.list_(pa.int32())).fill_null([])
                first = column.offsets.to_numpy().astype(np.int64)
                raw, at = ranks.decode(column.values.to_numpy(zero_copy_only=False).astype(np.int64), first)
                data = raw.tobytes()
                texts = pa.array([data[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*kept, text])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, `{text}` string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of each text's ids and of the bytes decoded from those ids.

    The ids of a slice of texts are made, digested, decoded and dropped, so that no
    column of ids leaves the Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, encoder = tokenizer(path)
        for batch in batches:
            for a, b, raw, offs in K.slices(_column(batch, "text")):
                ids, first = encoder.rows(raw, offs)
                packed = ids.astype("<u4").view(np.uint8).data
                decoded, at = ranks.decode(ids, first)
                decoded = np.ascontiguousarray(decoded).data
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(first)),
                        pa.array([hashlib.sha256(packed[4 * x : 4 * y]).hexdigest() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]),
                        pa.array([hashlib.sha256(decoded[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
