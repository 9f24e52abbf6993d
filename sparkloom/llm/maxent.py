"""Language-model scoring by a hashed maximum-entropy model.

A token's probability is that of its class given the tokens before it, times that of
the token in its class given the token before it:

* The class is predicted by a softmax over ``CLASSES`` whose weights are rows of
  hashed features: a bias, the preceding token, the token before it and the one
  before that (skip features), and the preceding pair (n-gram). Here tokens enter
  features by ``BUCKETS`` buckets of their last letters.
* Inside a class the softmax has two features: the token, and the pair of the whole
  preceding word and the whole token, hashed to so many bits
  that few share one (``_Grid``). The weight of the
  token alone is log u, with u = (c + 0.1) / (N + 0.1 (V + 1)) by the class's counts
  (a class keeps the share of one unseen token). Every pair that occurs in training
  texts has a weight w of its own, fitted by gradient steps of the penalised likelihood
  (``pair_weights``), and sum(u exp(w)) over the class, 1 where no pair is known, is
  summed over all pairs of a context. So all probabilities sum to one, and what is
  gathered grows with the corpus: a count for each word, pair and context.

Buckets are joined into classes by k-means over what follows them.

The texts are cut into blocks once: every block holds its token stream as places in
its own list of distinct words, so words are hashed and counted per block before
anything is shuffled, and a block gets back the corpus counts of its own words, pairs
and contexts only; no vocabulary is broadcast. A block's entries go out as sorted arrays,
one for each part of the hash range (``_totals``); parts hold the entries of
some ``PART_TOKENS`` tokens whatever the corpus, and a word or pair, however
frequent, has one entry per block. All counts cover all training texts, and each block's
training texts take part in one of ``ROUNDS`` rounds of gradient updates of the classes:
the tasks of a round update the weights by AdaGrad (one rate per row) over their blocks,
and the new weights are the mean of theirs, row by row, by how often each has met the
row. What goes to the driver are sums of a fixed size.

Null texts are empty texts, of one token, the end. Rows with a null doc_id are
learned from. Repeated rows count as often as they occur. Without training texts all
counts are 0 and every score follows from the formula. Other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

CLASSES = 32
BUCKETS = 4096
PAIRS = 8192
#: Coarse buckets of the following token, for the classes.
PROFILE = 64
ROUNDS = 4
BATCH = 4096
RATE = 0.3
#: Tokens of a batch with the same feature that are added up one after another.
SHORT_RUN = 7
#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
SUM_PARTS = 16
#: Pairs and contexts are hashed to this many bits more than the number of tokens has: one in 4,096 shares its place at most.
SPARE_BITS = 12
#: Weight of the squares of the pairs' weights in what is minimised.
PENALTY = 0.1
STEPS = 12
#: Tokens whose entries make up a part of the hash range, about.
PART_TOKENS = 2 << 20
WORDS, PAIRED, CONTEXTS, NORMS = range(4)

_RARE = 0xFFFF
_END_KEY = np.uint64(0x0E4D)
ROWS = 1 + 3 * BUCKETS + PAIRS
_SCHEMA = "block long, turn int, doc_ids array<long>, held binary, first binary, size long, tokens binary, rare binary, keys binary, buckets binary, counts binary"


def _shrunk(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed planes of bytes, of as many bytes each as the largest takes."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8 or 1
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<BQ", width, len(values)) + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def _opened(data: bytes) -> np.ndarray:
    """The numbers that ``_shrunk`` has packed."""
    width, count = struct.unpack_from("<BQ", data)
    out = np.zeros((count, 8), dtype=np.uint8)
    if count:
        out[:, :width] = np.frombuffer(pa.decompress(data[9:], decompressed_size=width * count, codec="zstd"), np.uint8).reshape(width, count).T
    return out.view(np.uint64).ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """The token streams of docs (doc_id, text, held_out), in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, held, streams, kinds, sizes, bytes_held = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, bytes_held
            stream, kind = np.concatenate(streams), np.concatenate(kinds)
            counts = np.concatenate(sizes)
            first = np.append(0, np.cumsum(counts))
            out_of = np.array(held, dtype=bool)
            keys, one, tokens, often = np.unique(stream, return_index=True, return_inverse=True, return_counts=True)
            # frequent words come first, so most places fit into 16 bits; the rest stand in a list of their own
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order))
            keys, one, tokens = keys[order], one[order], place[tokens]
            learned = np.repeat(~out_of, counts)
            block = part << 32 | number
            columns = [
                pa.array([block]),
                pa.array([(part + number) % ROUNDS], pa.int32()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([out_of.tobytes()], pa.binary()),
                pa.array([_shrunk(first)], pa.binary()),
                pa.array([len(tokens)]),
                *(pa.array([x], pa.binary()) for x in (_shrunk(np.minimum(tokens, _RARE)), _shrunk(tokens[tokens >= _RARE]), keys.tobytes(), _shrunk(kind[one]), _shrunk(np.bincount(tokens[learned], minlength=len(keys))))),
            ]
            for x in (ids, held, streams, kinds, sizes):
                x.clear()
            number, bytes_held = number + 1, 0
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            for a, b, raw, offs in K.slices(batch.column(1)):
                starts, ends, first = K.words(raw, offs)
                hasher = K.RangeHasher(raw, lower=True)
                keys = hasher(starts, ends)
                kind = (hasher(np.maximum(starts, ends - 4), ends) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.uint16)
                streams.append(np.insert(keys, first[1:], _END_KEY))
                kinds.append(np.insert(kind, first[1:], 0))
                sizes.append(np.diff(first) + 1)
                ids += batch.column(0).slice(a, b - a).to_pylist()
                held += batch.column(2).slice(a, b - a).to_pylist()
                bytes_held += len(raw)
                if bytes_held >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(run, _SCHEMA)


@dataclass
class Block:
    """A block's columns, opened."""

    doc_ids: list
    held: np.ndarray
    first: np.ndarray
    tokens: np.ndarray
    buckets: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        tokens = _opened(row["tokens"]).astype(np.int32)
        tokens[tokens == _RARE] = _opened(row["rare"])
        keys = np.frombuffer(row["keys"], dtype=np.uint64) if "keys" in row else None
        counts = _opened(row["counts"]).astype(np.int64) if "counts" in row else None
        return cls(row["doc_ids"], np.frombuffer(row["held"], dtype=bool), _opened(row["first"]).astype(np.int64), tokens, _opened(row["buckets"]).astype(np.uint16), keys, counts)

    def learned(self) -> np.ndarray:
        """Which tokens are learned from."""
        return np.repeat(~self.held, np.diff(self.first))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each token, and the rows of its features (but the bias, which is row 0)."""
        bucket = self.buckets[self.tokens].astype(np.int64)
        n = len(bucket)
        place = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        rows = np.zeros((n, 4), dtype=np.min_scalar_type(ROWS))  # 16 bits, which numpy sorts by radix
        before = []
        for k in (1, 2, 3):
            back = np.zeros(n, dtype=np.int64)
            back[k:] = bucket[:-k]
            back[place < k] = 0  # the beginning counts as an end
            before.append(back)
            rows[:, k - 1] = 1 + (k - 1) * BUCKETS + back
        rows[:, 3] = 1 + 3 * BUCKETS + (before[0] * 40503 + before[1] * 60013 >> 3) % PAIRS
        return bucket, rows


@dataclass
class _Grid:
    """How keys are hashed and dealt out: 2**parts parts, and pairs and contexts of ``bits`` bits."""

    parts: int
    bits: int

    @classmethod
    def of(cls, tokens: int, partitions: int) -> _Grid:
        """A part for PART_TOKENS tokens, and no fewer parts than half the partitions of a shuffle."""
        parts = max(0, math.ceil(math.log2(max(tokens / PART_TOKENS, partitions / 2, 1))))
        return cls(parts, min(64, max(32, parts, tokens.bit_length() + SPARE_BITS)))

    def width(self, kind: int) -> int:
        return 64 if kind == WORDS else self.bits

    def cuts(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts that sorted keys fall into, and the edges between them."""
        part = (keys >> np.uint64(self.width(kind) - self.parts)).astype(np.int64) if self.parts else np.zeros(len(keys), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]])
        return part[edges[:-1]], edges

    def base(self, kind: int, part: int) -> np.uint64:
        """The least key of a part."""
        return np.uint64(int(part) << (self.width(kind) - self.parts))


class Pairs:
    """The distinct pairs of a block (preceding word and token) and their contexts (preceding word and class), by hash."""

    def __init__(self, block: Block, class_of: np.ndarray, bits: int):
        spare = np.uint64(64 - bits)
        word = block.keys[block.tokens]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[block.first[:-1]] = _END_KEY  # the beginning counts as an end
        before = K.mix(before)
        self.keys, one, self.of_token = np.unique(K.mix(before * np.uint64(3) + word) >> spare, return_index=True, return_inverse=True)
        self.word = block.tokens[one]
        kind = class_of[block.buckets[self.word]].astype(np.uint64)
        self.contexts, self.context = np.unique(K.mix(before[one] + kind) >> spare, return_inverse=True)
        self.counts = np.bincount(self.of_token[block.learned()], minlength=len(self.keys))
        self.context_counts = np.bincount(self.context, self.counts, minlength=len(self.contexts)).astype(np.int64)


def pair_weights(count: np.ndarray, context: np.ndarray, share: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The weight of each pair that occurs ``count`` times, its context ``context`` times, its token having ``share`` of its class.

    Newton steps along the gradient count - context * share * exp(w) - penalty * w,
    which has one root; pairs never seen in training have no weight (0).
    """
    out = np.zeros(len(count))
    seen = np.flatnonzero(count > 0)
    n, expected = count[seen].astype(np.float64), context[seen] * share[seen]
    w = np.clip(np.log(n / expected), -20, 20)
    for _ in range(STEPS):
        model = expected * np.exp(w)
        w += np.clip((n - model - penalty * w) / (model + penalty), -1, 1)
    out[seen] = w
    return out


_ENTRIES = "part int, block long, kind int, keys binary, value binary, class binary"
_RETURNED = "block long, kind int, part int, data binary, lead binary, n long, v long"


def _entries(block: int, kind: int, grid: _Grid, keys: np.ndarray, values: np.ndarray, classes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A block's sorted keys and their values (of norms, the bits of a float32), a row for each part of the range of keys."""
    part, edges = grid.cuts(kind, keys)
    for a in range(0, len(part), 256):
        some = [(p, slice(x, y)) for p, x, y in zip(part[a : a + 256], edges[a:], edges[a + 1 :], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in some], pa.int32()),
                pa.array([block] * len(some), pa.int64()),
                pa.array([kind] * len(some), pa.int32()),
                pa.array([_shrunk(np.diff(keys[x], prepend=grid.base(kind, p))) for p, x in some], pa.binary()),
                pa.array([_shrunk(values[x]) for _, x in some], pa.binary()),
                pa.array([None if classes is None else classes[x].tobytes() for _, x in some], pa.binary()),
            ],
            names=[c.split()[0] for c in _ENTRIES.split(", ")],
        )


def _bits(values: np.ndarray) -> np.ndarray:
    return values.astype(np.float32).view(np.uint32)


def _floats(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.uint32).view(np.float32).astype(np.float64)


def _totals(entries: DataFrame) -> DataFrame:
    """For each row of entries, the sums of its keys' values over all blocks, in the order of its keys.

    ``lead`` marks the keys whose first block this is; it is given for pairs. Words give
    rows of block -1 besides, with the tokens (n) and distinct words (v) of each class (kind).
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("block", "ascending")])
        kinds = table.column("kind").to_numpy()
        out: dict[str, list] = {c.split()[0]: [] for c in _RETURNED.split(", ")}

        def add(block, kind, data=None, lead=None, n=None, v=None):
            for name, value in zip(out, (block, kind, key[0].as_py(), data, lead, n, v), strict=True):
                out[name].append(value)

        for kind in np.unique(kinds):
            rows = table.filter(pa.array(kinds == kind)).select(["block", "keys", "value", "class"]).to_pylist()
            gaps, values = [_opened(r["keys"]) for r in rows], np.concatenate([_opened(r["value"]) for r in rows])
            edges = np.append(0, np.cumsum([len(x) for x in gaps]))
            keys, one, at = np.unique(np.concatenate([np.cumsum(x) for x in gaps]), return_index=True, return_inverse=True)
            if kind == NORMS:
                values = _floats(values)
            total = np.bincount(at, values, minlength=len(keys))  # exact below 2**53
            if kind == WORDS:
                kept = total > 0
                word_class = np.frombuffer(b"".join(r["class"] for r in rows), np.uint8)[one][kept]
                n, v = np.bincount(word_class, total[kept], minlength=CLASSES), np.bincount(word_class, minlength=CLASSES)
                for k in np.flatnonzero(v):
                    add(-1, int(k), n=int(n[k]), v=int(v[k]))
            lead = np.zeros(len(at), dtype=bool)
            lead[one] = True
            for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
                mine = total[at[a:b]]
                add(r["block"], int(kind), _shrunk(_bits(mine) if kind == NORMS else mine), np.packbits(lead[a:b]).tobytes() if kind == PAIRED else None)
        types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], types[c.split()[1]]) for c in _RETURNED.split(", ")})

    return entries.groupBy("part").applyInArrow(run, _RETURNED)


def _counts(made: DataFrame, class_of: np.ndarray, grid: _Grid) -> DataFrame:
    """The entries of every block's words, pairs and contexts, with their occurrences in training texts."""
    shared = made.sparkSession.sparkContext.broadcast(class_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                order = np.argsort(block.keys)
                yield from _entries(row["block"], WORDS, grid, block.keys[order], block.counts[order], shared.value[block.buckets[order]].astype(np.uint8))
                pairs = Pairs(block, shared.value, grid.bits)
                yield from _entries(row["block"], PAIRED, grid, pairs.keys, pairs.counts)
                yield from _entries(row["block"], CONTEXTS, grid, pairs.contexts, pairs.context_counts)

    return made.select("block", *_STREAM, "keys", "counts").mapInArrow(run, _ENTRIES)


class Counted:
    """A block with the corpus counts of its words, pairs and contexts, and the weights of its pairs."""

    def __init__(self, row: dict, returned: pa.Table, grid: _Grid, class_of: np.ndarray, n_class: np.ndarray, v_class: np.ndarray):
        self.block = block = Block.of(row)
        self.pairs = pairs = Pairs(block, class_of, grid.bits)
        found: dict[int, list] = {kind: [] for kind in (WORDS, PAIRED, CONTEXTS, NORMS)}
        for r in sorted(returned.select(["kind", "part", "data", "lead"]).to_pylist(), key=lambda r: r["part"]):
            found[r["kind"]].append((r["data"], r["lead"]))
        totals = {kind: np.concatenate([_opened(data) for data, _ in rows]) for kind, rows in found.items() if rows}
        self.counts = np.empty(len(block.keys), dtype=np.int64)
        self.counts[np.argsort(block.keys)] = totals[WORDS]
        edges = grid.cuts(PAIRED, pairs.keys)[1]
        self.lead = np.concatenate([np.unpackbits(np.frombuffer(lead, np.uint8), count=n) for (_, lead), n in zip(found[PAIRED], np.diff(edges), strict=True)]).astype(bool)
        self.norms = _floats(totals[NORMS]) if NORMS in totals else None
        pair_counts, context_counts = totals[PAIRED].astype(np.int64), totals[CONTEXTS].astype(np.int64)
        kind = class_of[block.buckets]
        self.share = (self.counts + 0.1) / (n_class[kind] + 0.1 * (v_class[kind] + 1))
        self.weights = pair_weights(pair_counts, context_counts[pairs.context], self.share[pairs.word])


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays that tasks have emitted in SUM_PARTS pieces (part int, salt int, data binary of float32).

    Pieces are added up per part and salt first, and the salts' sums after that, so what
    one task reads doesn't grow with the number of tasks. It holds one array per part.
    """

    width = -(-size // SUM_PARTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(data.as_buffer(), dtype=np.float64 if len(data.as_buffer()) == 8 * width else np.float32)
                if part not in totals:
                    totals[part] = np.zeros(len(values))
                totals[part] += values
        for part, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    schema = "part int, data binary"
    salts = max(1, common.partitions(rows.sparkSession) // SUM_PARTS)
    if salts > 1:
        rows = rows.repartition(SUM_PARTS * salts, "part", F.pmod("salt", F.lit(salts))).select("part", "data").mapInArrow(add, schema)
    found = rows.select("part", "data").repartition(SUM_PARTS, "part").mapInArrow(add, schema).collect()
    out = np.zeros(-(-size // SUM_PARTS) * SUM_PARTS).reshape(SUM_PARTS, -1)
    for row in found:
        out[row["part"]] = np.frombuffer(row["data"], dtype=np.float64)
    return out.ravel()[:size]


def _pieces(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    padded = np.zeros(-(-len(values) // SUM_PARTS) * SUM_PARTS, dtype=np.float32)
    padded[: len(values)] = values
    salt = TaskContext.get().partitionId()
    for k, piece in enumerate(padded.reshape(SUM_PARTS, -1)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["part", "salt", "data"])


_STREAM = ["doc_ids", "held", "first", "tokens", "rare", "buckets"]


def _profiles(made: DataFrame) -> np.ndarray:
    """How often each bucket is followed by each coarse bucket, over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * PROFILE, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                bucket = block.buckets[block.tokens].astype(np.int64)
                inner = np.ones(len(bucket), dtype=bool)
                inner[block.first[1:] - 1] = False
                inner &= block.learned()
                at = np.flatnonzero(inner[:-1])
                total += np.bincount(bucket[at] * PROFILE + bucket[at + 1] % PROFILE, minlength=len(total))
        yield from _pieces(total)

    return _summed(made.select(*_STREAM).mapInArrow(run, "part int, salt int, data binary"), BUCKETS * PROFILE).reshape(BUCKETS, PROFILE)


def classes(profiles: np.ndarray, count: int = CLASSES) -> np.ndarray:
    """A class for each bucket; class 0 is the end alone."""
    weight = profiles.sum(axis=1)
    share = np.sqrt(profiles / np.maximum(weight, 1)[:, None])
    known = np.flatnonzero(weight[1:] > 0) + 1
    out = np.arange(len(profiles)) % (count - 1) + 1
    out[0] = 0
    if len(known) >= count:
        heavy = known[np.argsort(-weight[known], kind="stable")]
        centre = [share[heavy[0]]]
        far = ((share[heavy] - centre[0]) ** 2).sum(axis=1)
        while len(centre) < count - 1:  # the heaviest of what is far from all centres
            centre.append(share[heavy[int(np.argmax(far * np.sqrt(weight[heavy])))]])
            far = np.minimum(far, ((share[heavy] - centre[-1]) ** 2).sum(axis=1))
        centres = np.array(centre)
        for _ in range(15):
            near = ((share[known][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            for k in range(count - 1):
                mine = known[near == k]
                if len(mine):
                    centres[k] = np.average(share[mine], axis=0, weights=weight[mine])
        out[known] = near + 1
    return out


def _run_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of ``order``. Most runs are a few rows, which are added place by place; reduceat takes the long ones."""
    out = values[order[starts]]
    long = np.flatnonzero(counts > SHORT_RUN)
    if len(long):
        edges = np.append(0, np.cumsum(counts[long]))
        out[long] = np.add.reduceat(values[order[K.expand(starts[long], counts[long])]], edges[:-1], axis=0)
    short = np.flatnonzero((counts > 1) & (counts <= SHORT_RUN))
    for k in range(1, SHORT_RUN):
        if not len(short):
            break
        out[short] += values[order[starts[short] + k]]
        short = short[counts[short] > k + 1]
    return out


class Weights:
    """Feature rows by class, with AdaGrad's sum of squares for each row."""

    def __init__(self):
        self.rows = np.zeros((ROWS, CLASSES), dtype=np.float32)
        self.squares = np.full(ROWS, 1e-3, dtype=np.float32)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = self.rows[rows[:, 0]]
        for k in (1, 2, 3):
            out += self.rows[rows[:, k]]
        out += self.rows[0]
        return out

    def update(self, rows: np.ndarray, target: np.ndarray, met: np.ndarray) -> None:
        """One step over a batch of tokens; ``met`` counts how often each row was met."""
        p = self.logits(rows)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), target] -= 1
        for k in range(4):
            order = np.argsort(rows[:, k], kind="stable")
            sorted_rows = rows[order, k]
            starts = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
            used, counts = sorted_rows[starts], np.diff(np.append(starts, len(order)))
            gradient = _run_sums(p, order, starts, counts)
            gradient /= np.sqrt(counts).astype(np.float32)[:, None]
            self._step(used, gradient)
            met[used] += counts
        self._step(np.array([0]), p.sum(axis=0, keepdims=True) / np.float32(len(p)) ** 0.5)
        met[0] += len(p)

    def _step(self, used: np.ndarray, gradient: np.ndarray) -> None:
        squares = self.squares[used] + np.einsum("ij,ij->i", gradient, gradient) / np.float32(CLASSES)
        self.squares[used] = squares
        self.rows[used] -= gradient * (RATE / np.sqrt(squares))[:, None]


def train(made: DataFrame, class_of: np.ndarray, rounds: int = ROUNDS) -> Weights:
    """The class weights after one pass over all training texts."""
    context, weights = made.sparkSession.sparkContext, Weights()
    cells = ROWS * CLASSES
    for turn in range(rounds):
        shared = context.broadcast((weights, class_of))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            start, class_of = shared.value
            own = Weights()
            own.rows[:], own.squares[:] = start.rows, start.squares
            met = np.zeros(ROWS)
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.of(row)
                    bucket, rows = block.features()
                    take = np.flatnonzero(block.learned())
                    for a in range(0, len(take), BATCH):
                        at = take[a : a + BATCH]
                        own.update(rows[at], class_of[bucket[at]], met)
            if met[0]:
                change = (own.rows - start.rows) * met[:, None]
                yield from _pieces(np.concatenate([change.ravel(), own.squares - start.squares, met]))

        total = _summed(made.filter(F.col("turn") == turn).select(*_STREAM).mapInArrow(run, "part int, salt int, data binary"), cells + 2 * ROWS)
        met = np.maximum(total[cells + ROWS :], 1)[:, None]
        weights = Weights()
        weights.rows[:] = shared.value[0].rows + total[:cells].reshape(ROWS, CLASSES) / met
        weights.squares[:] = shared.value[0].squares + total[cells : cells + ROWS]
    return weights


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    ``held_out`` is a condition on the columns of ``docs``; what it holds for is not learned from.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    made = common.materialize(blocks(given), "blocks", {"parquet.block.size": 8 << 20}, tokens=F.sum("size"))
    grid = _Grid.of(made.measured["tokens"] or 0, common.partitions(spark))
    class_of = classes(_profiles(made))
    returned = common.materialize(_totals(_counts(made, class_of, grid)), "totals")
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in returned.filter("block = -1").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # CLASSES rows at most
        n_class[row["kind"]], v_class[row["kind"]] = row["n"], row["v"]
    n_all, v_all = int(n_class.sum()), int(v_class.sum())
    known = spark.sparkContext.broadcast((grid, class_of, n_class, v_class))

    def norms(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        this = Counted(row, right, *known.value)
        pairs = this.pairs
        change = np.where(this.lead, this.share[pairs.word] * np.expm1(this.weights), 0)
        sums = np.bincount(pairs.context, change, minlength=len(pairs.contexts))
        return pa.Table.from_batches(_entries(row["block"], NORMS, grid, pairs.contexts, _bits(sums)))

    streams = made.select("block", *_STREAM, "keys")
    counted = returned.filter("block >= 0").select("block", "kind", "part", "data", "lead")
    summed = _totals(streams.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(norms, _ENTRIES)).select(*counted.columns)
    shared = spark.sparkContext.broadcast(train(made, class_of))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        weights, class_of = shared.value, known.value[1]
        this = Counted(left.to_pylist()[0], right, *known.value)
        block, pairs, counts = this.block, this.pairs, this.counts
        base_word = np.log10((counts + 0.1) / (n_all + 0.1 * (v_all + 1)))
        inner = np.log(this.share[pairs.word]) + this.weights - np.log1p(this.norms[pairs.context])
        bucket, rows = block.features()
        target = class_of[bucket]
        picked = np.empty(len(bucket), dtype=np.float64)
        for a in range(0, len(bucket), BATCH):
            x = weights.logits(rows[a : a + BATCH])
            x -= x.max(axis=1, keepdims=True)
            picked[a : a + BATCH] = x[np.arange(len(x)), target[a : a + BATCH]] - np.log(np.exp(x).sum(axis=1, dtype=np.float64))
        starts = block.first[:-1]
        tokens = block.tokens
        return pa.table(
            {
                "doc_id": pa.array(block.doc_ids, pa.int64()),
                "held_out": pa.array(block.held),
                "n_tokens": pa.array(np.diff(block.first)),
                "n_known": pa.array(np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(starts), n_all, np.int64)),
                "base_score": pa.array(np.add.reduceat(base_word[tokens], starts)),
                "score": pa.array(np.add.reduceat((picked + inner[pairs.of_token]) / np.log(10), starts)),
            }
        )

    return streams.groupBy("block").cogroup(counted.unionByName(summed).groupBy("block")).applyInArrow(run, schema)

