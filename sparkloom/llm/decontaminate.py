"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-case words without ASCII
punctuation. The ``min_match``-word seeds of all items form a hashed table; a text
is joined with the items whose seeds it holds. For such a pair, running Karp-Rabin
matching of falling length finds common runs of words, and the longest are marked
first as tiles that overlap neither in the text nor in the item. The share of the
item's words under tiles is its coverage, wherever the tiles stand in the text, so
a passage whose parts have changed places is caught as well. Only the stretches of a
text that lie under seeds can hold a tile, so only they are tiled.

The benchmark is read in parts of about ``PART_WORDS`` words. One part at a time is
held by the driver and broadcast, and the texts are read once per part; what a part
gives is written before the next one is read.

Null or empty texts and items have no words, and match nothing; so do items of
fewer than ``min_match`` words. Repeated texts and items are reported each. Ties
between tiles go to the earlier place in the item, then in the text. Other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

#: Words of the shortest tile, and of a seed.
MIN_MATCH = 5
#: A text is contaminated by an item from this share of the item's words.
COVERAGE = 0.5
#: Words of one part of the benchmark.
PART_WORDS = 2_000_000
#: Pairs of equal windows looked at together.
PAIRS = 1 << 19


def tiles(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in the item, place in the text, length) of the tiles; values are compared for equality."""
    free_item, free_text = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool)
    found: list[tuple[int, int, int]] = []
    length = min(len(item), len(text), 32)
    if length < min_match:
        return found
    while free_item.any():
        matches = _scan(item, text, free_item, free_text, length)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, p, q) for p, q, n in matches]
        heapq.heapify(queue)
        while queue and free_item.any():
            n, p, q = heapq.heappop(queue)
            n = -n
            if free_item[p : p + n].all() and free_text[q : q + n].all():
                free_item[p : p + n] = free_text[q : q + n] = False
                found.append((p, q, n))
                continue
            # what marked tiles have left of the match
            k, both = 0, np.flatnonzero(~(free_item[p : p + n] & free_text[q : q + n]))
            for stop in [*both.tolist(), n]:
                if stop - k >= length:
                    heapq.heappush(queue, (k - stop, p + k, q + k))
                k = stop + 1
        if length == min_match:
            break
        length = max(min_match, length // 2)
    return found


def _scan(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """All maximal common runs of at least ``length`` unmarked words, by hashes of windows."""
    own, own_hash = _windows(item, free_item, length)
    other, other_hash = _windows(text, free_text, length)
    order = np.argsort(own_hash, kind="stable")
    own, own_hash = own[order], own_hash[order]
    low = np.searchsorted(own_hash, other_hash)
    count = np.searchsorted(own_hash, other_hash, side="right") - low
    other, low, count = other[count > 0], low[count > 0], count[count > 0]
    out, total, a = [], np.cumsum(count), 0
    while a < len(other):  # so many places of the text that their pairs stay few
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS)))
        p, q = own[K.expand(low[a:b], count[a:b])], np.repeat(other[a:b], count[a:b])
        before = (p > 0) & (q > 0)
        at = np.flatnonzero(before)
        before[at] = free_item[p[at] - 1] & free_text[q[at] - 1] & (item[p[at] - 1] == text[q[at] - 1])
        p, q = p[~before], q[~before]  # the others are part of a run that began before
        n, going = np.zeros(len(p), dtype=np.int64), np.arange(len(p))
        while len(going):
            x, y = p[going] + n[going], q[going] + n[going]
            inside = (x < len(item)) & (y < len(text))
            going, x, y = going[inside], x[inside], y[inside]
            going = going[(item[x] == text[y]) & free_item[x] & free_text[y]]
            n[going] += 1
        long = n >= length
        out += zip(p[long].tolist(), q[long].tolist(), n[long].tolist(), strict=True)
        a = b
    return out


def _windows(values: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of unmarked words."""
    n = len(values) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blocked = np.cumsum(np.append(0, ~free))
    places = np.flatnonzero(blocked[length:] == blocked[:-length])
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n]
    return places, rolled[places]


class Benchmark:
    """A part of the benchmark: the word sequences of its items and the table of their seeds."""

    def __init__(self, item_ids: list, texts: list, min_match: int):
        self.min_match, self.item_ids = min_match, item_ids
        hashes, first = _words(pa.array(texts, pa.string()))
        self.items = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        seeds, owner, place = [], [], []
        for k, words in enumerate(self.items):
            if len(words) >= min_match:
                made = _seeds(words, min_match)
                seeds.append(made), owner.append(np.full(len(made), k)), place.append(np.arange(len(made)))
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        distinct, self._first = np.unique(flat[order], return_index=True)
        self._first = np.append(self._first, len(flat))
        self._owner = np.concatenate(owner)[order] if seeds else np.zeros(0, np.int64)
        self._place = np.concatenate(place)[order] if seeds else np.zeros(0, np.int64)
        self._index = K.HashIndex(max(1, len(distinct)))
        self._index.insert(distinct, np.arange(len(distinct)))

    def search(self, hashes: np.ndarray, first: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(row, item, coverage, tiles) of the rows' contaminations. Places in the text count its words."""
        m = self.min_match
        if len(hashes) < m:
            return
        seed = self._index.find(_seeds(hashes, m))
        hits = np.flatnonzero(seed >= 0)
        rows = np.searchsorted(first, hits, side="right") - 1
        whole = hits + m <= first[rows + 1]
        hits, rows = hits[whole], rows[whole]
        for row in np.unique(rows):
            at = hits[rows == row]
            under = np.zeros(first[row + 1] - first[row], dtype=bool)
            for k in range(m):
                under[at - first[row] + k] = True
            entries = K.expand(self._first[seed[at]], np.diff(self._first)[seed[at]])
            owners, places = self._owner[entries], self._place[entries]
            words = hashes[first[row] : first[row + 1]]
            kept = np.flatnonzero(under)
            # stretches under seeds, parted by a word that occurs nowhere
            gaps = np.flatnonzero(np.diff(kept) > 1) + 1
            stretch = np.insert(words[kept], gaps, np.uint64(0))
            where = np.insert(kept, gaps, -1)
            for item in np.unique(owners):
                size = len(self.items[item])
                possible = np.zeros(size, dtype=bool)
                mine = places[owners == item]
                for k in range(m):
                    possible[mine + k] = True
                if possible.sum() < coverage * size:
                    continue
                found = [(p, int(where[q]), n) for p, q, n in tiles(self.items[item], stretch, m)]
                share = sum(t[2] for t in found) / size
                if share >= coverage:
                    yield int(row), int(item), share, found


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = K.buffers(pc.utf8_lower(column.fill_null("")))
    starts, ends, first = K.words(raw, offs, K.PUNCTUATION)
    return K.RangeHasher(raw)(starts, ends), first


def _seeds(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return K.mix(rolled)


def _parts(benchmark: DataFrame, min_match: int) -> Iterator[tuple[Benchmark, bool]]:
    """The benchmark in parts of bounded size, and whether each is the only one."""
    words = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-words // (4 * PART_WORDS)))
    for k in range(parts):
        rows = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows], min_match), parts == 1


def find(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest and spans (word places in the text, lengths) of each contamination."""
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest int, spans array<struct<item_word:int,text_word:int,words:int>>"
    spans = pa.list_(pa.struct([("item_word", pa.int32()), ("text_word", pa.int32()), ("words", pa.int32())]))

    def over(part) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = part.value
            for batch in batches:
                for a, b, _, _ in K.slices(batch.column(1)):
                    hashes, first = _words(batch.column(1).slice(a, b - a))
                    found = list(known.search(hashes, first, coverage))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).slice(a, b - a).take(pa.array([f[0] for f in found])),
                                pa.array([known.item_ids[f[1]] for f in found], pa.int64()),
                                pa.array([f[2] for f in found], pa.float64()),
                                pa.array([len(f[3]) for f in found], pa.int32()),
                                pa.array([max(t[2] for t in f[3]) for f in found], pa.int32()),
                                pa.array([[{"item_word": t[0], "text_word": t[1], "words": t[2]} for t in sorted(f[3])] for f in found], spans),
                            ],
                            names=["doc_id", "item_id", "coverage", "n_tiles", "longest", "spans"],
                        )

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

    context = docs.sparkSession.sparkContext
    out = None
    for part, alone in _parts(benchmark, min_match):
        shared = context.broadcast(part)
        if alone:
            return over(shared)
        found = common.materialize(over(shared), "found")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text no benchmark item contaminates."""
    context, text = docs.sparkSession.sparkContext, docs.columns.index("text")
    for known, alone in _parts(benchmark, min_match):
        shared = context.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], part=shared) -> Iterator[pa.RecordBatch]:
            known = part.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, b, _, _ in K.slices(batch.column(text)):
                    hashes, first = _words(batch.column(text).slice(a, b - a))
                    for row, *_ in known.search(hashes, first, coverage):
                        keep[a + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if not alone:
            docs = common.materialize(docs, "clean")
            shared.destroy()
    return docs
