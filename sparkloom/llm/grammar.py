"""Token-ID files compressed by a Re-Pair grammar per shard.

``write`` orders documents by ``doc_id``, encodes them with a tokenizer of the
tokenizers library, ends each with id ``END`` and cuts the stream into shards of
whole documents. A shard repeatedly replaces frequent pairs of ids by new
nonterminals: each round counts all pairs, takes those within a factor of the most
frequent, gives each a rule, and replaces their occurrences from left to right. A
shard stores the rules, the expansion length of every rule, the final symbols and
where each document begins, so any range of ids can be decoded without the rest
(``Shard.ids``).

Shard files are the binary payloads described at ``pack``, one per row of a Parquet
folder, so that they can lie in any store that Spark writes to.

Null and empty texts are documents of one id (the end). Null doc_ids come first;
repeated doc_ids are ordered by text, and rows equal in both are interchangeable.
Further columns of the input are ignored. A document longer than a shard is a shard
of its own.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from . import textkernel as K
from .bpe import CachedEncoder, _column

END = 0
#: Ids of a shard, unless one document has more.
SHARD_IDS = 1 << 20
#: A pair gets a rule if it occurs so often in the shard: a rule takes 16 bytes and saves a symbol of 2 bytes each time.
MIN_COUNT = 8
#: Each round replaces the pairs that occur at least 1 / SPREAD as often as the most frequent.
SPREAD = 16
#: Pre-tokens remembered per worker.
CACHE_TOKENS = 3 << 19

_MAGIC = 0x31475052  # "RPG1"


def compress(ids: np.ndarray, base: int, max_rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left and right of each rule, rules before each round). Rule k is symbol base + k.

    Rounds go on until no pair occurs MIN_COUNT times or all symbols of 16 bits are used.
    """
    symbols = ids.astype(np.int32)
    kind, shift = (np.uint32, np.uint32(16)) if base + max_rules <= 1 << 16 else (np.uint64, np.uint64(32))
    left, right, rounds = np.zeros(0, np.int32), np.zeros(0, np.int32), [0]
    while len(symbols) > 1 and len(left) < max_rules:
        keys = symbols[:-1].astype(kind) << shift | symbols[1:].astype(kind)
        ordered = np.sort(keys)
        edges = np.append(np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])), len(ordered))
        counts = np.diff(edges)
        least = max(MIN_COUNT, int(counts.max()) // SPREAD)
        chosen = np.flatnonzero(counts >= least)
        if not len(chosen):
            break
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")][: max_rules - len(left)]
        pairs = ordered[edges[chosen]]
        # a small hash table finds the pairs; of two with the same slot the rarer waits for a later round
        _, one = np.unique(_slots(pairs), return_index=True)
        pairs = np.sort(pairs[one])
        table = np.zeros(1 << 16, dtype=np.uint16)
        table[_slots(pairs)] = np.arange(len(pairs))
        rule = table[_slots(keys)]
        at = np.flatnonzero(pairs[rule] == keys)
        rule = rule[at].astype(np.int32)
        # of occurrences that overlap in a chain, every second stays
        begins = np.append(True, at[1:] != at[:-1] + 1)
        offset = at - at[begins][np.cumsum(begins) - 1]
        take = offset % 2 == 0
        at, rule = at[take], rule[take]
        symbols[at] = base + len(left) + rule
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        left = np.append(left, (pairs >> shift).astype(np.int32))
        right = np.append(right, (pairs & (kind(1) << shift) - kind(1)).astype(np.int32))
        rounds.append(len(left))
    return symbols, left, right, np.array(rounds, dtype=np.int64)


def _slots(keys: np.ndarray) -> np.ndarray:
    """16 bits of a multiplicative hash."""
    if keys.dtype == np.uint32:
        return keys * np.uint32(0x9E3779B1) >> np.uint32(16)
    return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """The file format of a shard.

    Little-endian: 8 int64 (magic, documents, ids, base, rules, rounds, symbols, bytes
    of a symbol); the ids of each document (int64); its doc_id (int64) and whether it
    has one (uint8); the rules before each round (int64); left, right (int32) and
    expansion length (int64) of each rule; the symbols (uint16 if they fit, else int32).
    """
    symbols, left, right, rounds = compress(ids, base, max(0, (1 << 16) - base) or 1 << 15)
    lengths = np.ones(base + len(left), dtype=np.int64)
    for a, b in zip(rounds[:-1], rounds[1:], strict=True):
        lengths[base + a : base + b] = lengths[left[a:b]] + lengths[right[a:b]]
    wide = 2 if base + len(left) <= 1 << 16 else 4
    head = np.array([_MAGIC, len(doc_ids), len(ids), base, len(left), len(rounds), len(symbols), wide], dtype="<i8")
    parts = [
        head,
        counts.astype("<i8"),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8"),
        np.array([d is not None for d in doc_ids], dtype="u1"),
        rounds.astype("<i8"),
        left.astype("<i4"),
        right.astype("<i4"),
        lengths[base:].astype("<i8"),
        symbols.astype("<u2" if wide == 2 else "<i4"),
    ]
    return b"".join(x.tobytes() for x in parts)


class Shard:
    """A shard file, opened."""

    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, dtype="<i8", count=8)
        if head[0] != _MAGIC:
            raise ValueError("not a shard file")
        _, docs, self.n_ids, self.base, rules, rounds, n, wide = (int(x) for x in head)
        self._at, self._payload = 64, payload
        self.counts = self._take("<i8", docs)
        values, present = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [int(v) if p else None for v, p in zip(values, present, strict=True)]
        self._rounds = self._take("<i8", rounds)
        self._left, self._right = self._take("<i4", rules), self._take("<i4", rules)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), self._take("<i8", rules)])
        self.symbols = self._take("<u2" if wide == 2 else "<i4", n).astype(np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._flat: np.ndarray | None = None
        self._ends: np.ndarray | None = None

    def _take(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self._payload, dtype=kind, count=count, offset=self._at)
        self._at += out.nbytes
        return out

    def _expansions(self) -> np.ndarray:
        """The ids of every symbol, one after another, filled in round by round."""
        if self._flat is None:
            self._flat = np.zeros(int(self.lengths.sum()), dtype=np.int32)
            self._flat[: self.base] = np.arange(self.base)
            for a, b in zip(self._rounds[:-1], self._rounds[1:], strict=True):
                for part, shift in ((self._left[a:b], 0), (self._right[a:b], self.lengths[self._left[a:b]])):
                    to = K.expand(self._starts[self.base + a : self.base + b] + shift, self.lengths[part])
                    self._flat[to] = self._flat[K.expand(self._starts[part], self.lengths[part])]
        return self._flat

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop``; only the symbols that cover them are expanded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.int32)
        if self._ends is None:
            self._ends = np.cumsum(self.lengths[self.symbols])
        a, b = np.searchsorted(self._ends, start, side="right"), np.searchsorted(self._ends, stop - 1, side="right") + 1
        part = self.symbols[a:b]
        out = self._expansions()[K.expand(self._starts[part], self.lengths[part])]
        skip = start - (int(self._ends[a - 1]) if a else 0)
        return out[skip : skip + stop - start]

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, with its end."""
        start = int(self.counts[:k].sum())
        return self.ids(start, start + int(self.counts[k]))


class LibraryEncoder:
    """Encodes rows as the tokenizers library does, one call per distinct pre-token.

    A text that holds one of the tokenizer's added tokens goes through the library as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder()
        self.base = max(self._tokenizer.get_vocab_size(with_added_tokens=True), max(added, default=0) + 1)
        self._added = [token.content.encode() for token in added.values()]
        self._pieces = CachedEncoder(self._encode_new, CACHE_TOKENS)

    def _encode_new(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Pieces that begin with a blank are encoded side by side, as one text: the tokenizer parts them there."""
        out: list = [None] * len(pieces)
        joined = [k for k, p in enumerate(pieces) if len(p) > 1 and p[0] == 0x20 and p[1] not in b" \t\n\v\f\r" and p[1] < 0x80]
        for a in range(0, len(joined), 1000):
            part = joined[a : a + 1000]
            found = self._tokenizer.encode(b"".join(pieces[k] for k in part).decode("utf-8"), add_special_tokens=False)
            ids, word = np.array(found.ids, dtype=np.int32), np.array(found.word_ids)
            cuts = np.flatnonzero(np.diff(word)) + 1
            if len(cuts) + 1 == len(part):
                for k, x in zip(part, np.split(ids, cuts), strict=True):
                    out[k] = x
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._tokenizer.encode_batch_fast([pieces[k].decode("utf-8") for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(x.ids, dtype=np.int32)
        return out

    def rows(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        ids, first = self._pieces.rows(raw, offs)
        if not any(a in data for a in self._added):
            return ids, first
        parts = []
        for k in range(len(offs) - 1):
            text = data[offs[k] : offs[k + 1]]
            if any(a in text for a in self._added):
                parts.append(np.array(self._tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, dtype=np.int32))
            else:
                parts.append(ids[first[k] : first[k + 1]])
        ends = np.zeros(len(offs), np.int64)
        np.cumsum([len(p) for p in parts], out=ends[1:])
        return np.concatenate(parts), ends


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


_FILES = "part long, shard long, within long, n_ids long, payload binary"


def write(docs: DataFrame, path: str, folder: str, shard_ids: int = SHARD_IDS) -> None:
    """Writes the shard files of ``docs`` (doc_id, text) to ``folder``.

    ``part`` and ``shard`` number the shards in ascending order of doc_id; ``within`` is
    the number of ids before a shard in its part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        waiting: list[tuple[list, np.ndarray, np.ndarray]] = []
        held = within = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held, within
            ids = np.concatenate([x[2] for x in waiting])
            payload = pack([d for x in waiting for d in x[0]], np.concatenate([x[1] for x in waiting]), ids, library.base)
            out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([within]), pa.array([len(ids)]), pa.array([payload], pa.binary())], names=["part", "shard", "within", "n_ids", "payload"])
            waiting.clear()
            shard, held, within = shard + 1, 0, within + len(ids)
            return out

        for batch in batches:
            for a, b, raw, offs in K.slices(_column(batch, "text")):
                ids, first = library.rows(raw, offs)
                ids = np.insert(ids, first[1:], END)
                counts = np.diff(first) + 1
                if held and held + len(ids) > shard_ids:
                    yield flush()
                waiting.append((batch.column(0).slice(a, b - a).to_pylist(), counts, ids))
                held += len(ids)
        if waiting:
            yield flush()

    shards = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(common.partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(run, _FILES)
    )
    shards.write.option("parquet.block.size", 8 << 20).option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    shards = spark.read.schema(_FILES).parquet(folder)
    # ids before each part: one row per written partition, so the window and the table are small
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(payload.as_py())
                data = shard.ids().astype("<u4").view(np.uint8).data
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(offset + starts), pa.array(shard.counts), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = common.join_small(shards, common.materialize(parts, "parts"), "part").select((F.col("before") + F.col("within")).alias("offset"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{common.shared_folder(spark)}/sparkloom-shards-{uuid.uuid4().hex}"
    write(docs, path, folder)
    common._written.append(folder)
    return read(spark, folder)
