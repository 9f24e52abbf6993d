"""N-gram Jaccard join with signature trees.

A text's set holds the hashes of its distinct word n-grams. Two texts link when the
overlap of their sets is at least ``threshold`` (a whole percentage) of their union.

Inside a group of texts, a signature tree finds the links (``links``): leaves hold a
text's bitmap of hashed n-grams and its size; inner nodes hold the OR of their
children's bitmaps (and the AND, the bits that all members have) and their range of
sizes. The tree is traversed against itself: for a pair of nodes, the bits that all
members of one have and no member of the other has bound the overlap of any two
members from above, and the pair is dropped when that is too little for a link. What
reaches the leaves is counted exactly. Pairs of texts that are already connected
are left out, and so are pairs of nodes all of whose texts are, so a group of copies
costs as much as it has texts, not pairs.

Groups come from the data, without loss. In any one order of all n-grams, two sets of
at most n n-grams that link share one of the first n - ceil(t n) + 1 n-grams of each. The
order taken is by a count of all n-grams over a fixed number of hashed buckets
(``SKETCH_BITS``), rarest first, so that passages that many texts share are keys only of
texts that have little else; a count that is too high costs work, never a link. Sets that
share a key form a block (blocks of the same sets are one). The trees of the blocks, over
bitmaps only, leave candidate edges, as a forest; their components are clusters that no link
leaves. In each cluster, a tree over the n-grams themselves gives the links, again as a
forest, and the components of those are the result. A tree of one leaf (``FANOUT`` sets at
most) is done together with others of its kind.

Blocks and clusters beyond ``CHUNK`` members go by rounds (``_by_rounds``): chunks by
themselves, then a few members of each component, then what is still apart, so that a
group of near copies takes neither a task of its own nor the square of its members.
``join`` with ``count`` and ``pairs`` look at all links instead: every two chunks of a cluster
meet in a cell, without regard to what is connected (an edge is given only between
components), and equal sets, which are one node, count as often as there are documents of
them. This is work with the square of a cluster's different texts, as are its links.

Equal sets are one node from the start, named by a 64-bit hash of the size and of two
64-bit sums over the set.

Texts that are null or without words have empty sets and link with nothing. Texts of
fewer words than n have one n-gram, all their words. Rows with a null doc_id take no
part (their component is null). Rows that repeat a doc_id with the same set are one
document; with different sets, all of them belong to one component, and each row has its
own size and number of links. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K
from .components import connected

NGRAM = 4
THRESHOLD = 85
#: Members of a block or cluster in a chunk; in a cluster, sets of over 512 n-grams count more.
CHUNK = 512
#: The order of n-grams comes from counts in 2 ** SKETCH_BITS buckets, summed in PIECES.
SKETCH_BITS = 20
PIECES = 16
#: A key in more rows than this (and than four times the mean of buckets) is dealt over several tasks.
HOT_KEY = 1 << 15
#: Members of a component of a large group that meet those of others in the second round.
REPRESENTATIVES = 8
#: Rows of cells (32 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits of the bitmap of doc_ids whose texts are looked at again, at most (16 MB).
MARK_BITS = 1 << 27
#: Cells are looked at in tables of about so many rows or bytes.
WINDOW_ROWS = 1 << 13
WINDOW_BYTES = 8 << 20
FANOUT = 8
#: Node pairs looked at together.
FRONT = 1 << 13
#: Bytes of a cluster's exact bitmaps; beyond, sets are intersected pair by pair.
EXACT_BYTES = 48 << 20

_U64 = np.uint64


def sets(column: pa.Array, ngram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct n-gram hashes in ascending order, row offsets) of slices of texts."""
    for a, b, raw, offs in K.slices(column):
        yield a, b, *K.sorted_sets(*K.shingle_hashes(*K.word_hashes(raw, offs), ngram))


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.append(_U64(0), np.cumsum(values))
    return sums[first[1:]] - sums[first[:-1]]


def bitmap(values: np.ndarray) -> np.ndarray:
    """A set's bitmap as 64-bit words; it has at least one bit per value, a power of two and 64 at least."""
    width = 1 << max(6, int(len(values) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(values & _U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, length: int) -> np.ndarray:
    """A bitmap brought to fewer words by OR."""
    while len(words) > length:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


class SignatureTree:
    """Levels of nodes over texts that are ordered by size and bitmap; level 0 holds the texts."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        self.levels = [(bitmaps, bitmaps, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            some, every, low, high = self.levels[-1]
            starts = np.arange(0, len(some), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(some, starts), np.bitwise_and.reduceat(every, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
        """Whether node pairs may hold a link, by the greatest overlap their members can have."""
        some, every, low, high = self.levels[level]
        left = high[a] - np.bitwise_count(every[a] & ~some[b]).sum(axis=1, dtype=np.int64)
        right = high[b] - np.bitwise_count(every[b] & ~some[a]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(left, right)
        return ((100 + threshold) * overlap >= threshold * (low[a] + low[b])) & (100 * overlap >= threshold * np.maximum(low[a], low[b]))


def links(sizes: np.ndarray, bitmaps: list[np.ndarray], threshold: int, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, side: np.ndarray | None = None, every: bool = False, labels: np.ndarray | None = None) -> list[tuple[int, int]] | np.ndarray:
    """A spanning forest of the links between the texts of a group (of the possible ones if ``exact`` is None).

    With sides, only links between different ones are looked for. Texts of the same label
    count as connected. With ``every``, all links are given, as the rows of an array.
    """
    n = len(sizes)
    if side is None:
        side = np.arange(n)
    length = min(len(x) for x in bitmaps)
    folded = np.array([fold(x, length) for x in bitmaps])
    order = np.lexsort((*folded.T[::-1][-2:], sizes))
    tree, side = SignatureTree(sizes[order], folded[order]), side[order]
    label = np.arange(n) if labels is None or every else _first_alike(labels[order])
    forest: list[tuple[int, int]] = []
    found = [np.zeros((0, 2), dtype=np.int64)]

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def flat() -> np.ndarray:
        nonlocal label
        while (label[label] != label).any():
            label = label[label]
        return label

    top = len(tree.levels) - 1
    a, b = np.triu_indices(len(tree.levels[top][0]))
    stack = [(top, a, b)]
    starts = np.arange(0, n, FANOUT)
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONT:
            stack.append((level, a[FRONT:], b[FRONT:]))
            a, b = a[:FRONT], b[:FRONT]
        if level == 0:
            now = flat()
            open_pairs = (side[a] != side[b]) & (every | (now[a] != now[b]))
            a, b = a[open_pairs], b[open_pairs]
        elif level == 1 and not every:
            now = flat()
            low, high = np.minimum.reduceat(now, starts), np.maximum.reduceat(now, starts)
            open_pairs = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[open_pairs], b[open_pairs]
        if not len(a):
            continue
        keep = tree.possible(level, a, b, threshold)
        a, b = a[keep], b[keep]
        if level:
            below = len(tree.levels[level - 1][0])
            i = np.repeat(a * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(np.arange(FANOUT), FANOUT), len(a))
            j = np.repeat(b * FANOUT, FANOUT * FANOUT) + np.tile(np.arange(FANOUT), len(a) * FANOUT)
            real = (i < below) & (j < below) & (i <= j)
            stack.append((level - 1, i[real], j[real]))
            continue
        step = FRONT if every else 512  # so that what has been connected spares the next pairs
        for k in range(0, len(a), step):
            now = flat()
            x, y = a[k : k + step], b[k : k + step]
            fresh = every | (now[x] != now[y])
            x, y = x[fresh], y[fresh]
            if exact is not None and len(x):
                linked = exact(order[x], order[y])
                x, y = x[linked], y[linked]
            if every:
                found.append(np.column_stack([order[x], order[y]]))
                continue
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                rp, rq = root(p), root(q)
                if rp != rq:
                    label[max(rp, rq)] = min(rp, rq)
                    forest.append((int(order[p]), int(order[q])))
    return np.concatenate(found) if every else forest


def _first_alike(values: np.ndarray) -> np.ndarray:
    """The index of the first equal value."""
    _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
    return first[inverse]


def overlap_counter(texts: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Counts exactly what the sets of the given pairs share."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    values, inverse, counts = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1  # values of one text only are in no overlap
    width = -(-int((counts > 1).sum()) // 64)
    if len(texts) * width * 8 <= EXACT_BYTES:
        maps = np.zeros((len(texts), max(1, width)), dtype=np.uint64)
        rows = np.repeat(np.arange(len(texts)), sizes)
        keep = counts[inverse] > 1
        bit = shared[inverse[keep]]
        np.bitwise_or.at(maps, (rows[keep], bit >> 6), _U64(1) << (bit & 63).astype(np.uint64))
        return lambda a, b: np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
    return lambda a, b: np.array([len(np.intersect1d(texts[i], texts[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], dtype=np.int64)


def exact_counter(texts: list[np.ndarray], threshold: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells by exact set sizes which of the given pairs link."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    overlap = overlap_counter(texts)

    def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = overlap(a, b)
        return 100 * both >= threshold * (sizes[a] + sizes[b] - both)

    return check


def prefix_length(sizes: np.ndarray, threshold: int) -> np.ndarray:
    """How many n-grams of a set, in one order of all n-grams, must be looked at: linked sets share one of these."""
    return np.where(sizes > 0, sizes - (threshold * sizes + 99) // 100 + 1, 0)


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> _U64(64 - SKETCH_BITS)).astype(np.int64)


def rare_first(values: np.ndarray, first: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index into values) of each set's rarest n-grams, as many as ``prefix_length`` tells."""
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # values ascend within a row, so equal counts keep that order
    order = np.argsort((row.astype(np.uint64) << _U64(40)) | np.minimum(counts[_bucket(values)], _U64((1 << 40) - 1)), kind="stable")
    rank = np.arange(len(values)) - first[row]
    chosen = rank < prefix_length(sizes, threshold)[row]
    return row[chosen], order[chosen]


def _node_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The name of each set: a hash of its size and of two sums over its n-grams."""
    one, two = (_row_sums(K.mix(values ^ _U64(c)), first) for c in (0x1234567, 0x89ABCDE))
    return K.mix(one ^ K.mix(two + np.diff(first).astype(np.uint64))).view(np.int64)


_DESCRIBED = "doc_id long, n_shingles long, node long, map binary, piece int, counts binary"


def _described(docs: DataFrame, ngram: int) -> DataFrame:
    """doc_id, n_shingles, name of the set and its bitmap; and each task's n-gram counts by bucket, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for a, b, values, first in sets(batch.column(1), ngram):
                np.add.at(counts, _bucket(values), np.uint32(1))
                maps = [bitmap(values[x:y]).tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                rows = b - a
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), pa.array(np.diff(first)), pa.array(_node_hashes(values, first)), pa.array(maps, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=["doc_id", "n_shingles", "node", "map", "piece", "counts"],
                )
        full = [(k, _packed(part)) for k, part in enumerate(np.split(counts, PIECES)) if part.any()]
        if full:
            nothing = [pa.nulls(len(full), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([k for k, _ in full], pa.int32()), pa.array([c for _, c in full], pa.binary())], names=["doc_id", "n_shingles", "node", "map", "piece", "counts"])

    return docs.mapInArrow(run, _DESCRIBED)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest takes, compressed."""
    kind = np.min_scalar_type(int(counts.max()))
    return kind.char.encode() + pa.compress(counts.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    size = (1 << SKETCH_BITS) // PIECES * kind.itemsize
    return np.frombuffer(pa.decompress(data[1:], decompressed_size=size, codec="zstd", asbytes=True), dtype=kind).astype(np.uint64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces of a task, as they come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = _unpacked(part)
            sums[k] = sums[k] + part if k in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], names=["piece", "counts"])


def _sketch(described: DataFrame) -> np.ndarray:
    """The counts of all n-grams by bucket: a fixed number of sums, whatever the input."""
    n = common.partitions(described.sparkSession)
    pieces = described.filter("piece IS NOT NULL").select("piece", "counts", (F.spark_partition_id() % F.lit(n)).alias("salt"))
    pieces = pieces.repartition(n, "piece", "salt").select("piece", "counts").mapInArrow(_summed, "piece int, counts binary")
    pieces = pieces.repartition(n, "piece").mapInArrow(_summed, "piece int, counts binary")
    counts = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), dtype=np.uint64)
    for row in pieces.toArrow().to_pylist():
        counts[row["piece"]] = _unpacked(row["counts"])
    return counts.ravel()


def _keys(docs: DataFrame, ngram: int, threshold: int, counts: np.ndarray) -> DataFrame:
    """(key, salt, node) of the rarest n-grams of every set; equal sets of one task give theirs once.

    The rows of a key that may be very frequent, by its bucket, are dealt over salts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    hot = max(HOT_KEY, 4 * int(counts.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, values, first in sets(batch.column(1), ngram):
                nodes = _node_hashes(values, first)
                fresh = np.zeros(len(nodes), dtype=bool)
                for k, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        fresh[k] = True
                        seen.add(node)
                sizes = np.where(fresh, np.diff(first), 0)
                values = values[np.repeat(fresh, np.diff(first))]
                rows, at = rare_first(values, np.append(0, np.cumsum(sizes)), counts, threshold)
                if len(rows):
                    keys = values[at]
                    often = counts[_bucket(keys)]
                    salts = np.where(often > hot, 1 + (K.mix(nodes[rows].view(np.uint64)) % np.maximum(often // _U64(HOT_KEY // 2), _U64(1))).astype(np.int64), 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(salts), pa.array(nodes[rows])], names=["key", "salt", "node"])

    return docs.mapInArrow(run, "key long, salt int, node long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, node) of the keys that several sets have, from rows in the order of keys, salts and nodes.

    Keys with the same sets are one block, named by a hash of them; a very long run, and
    one of a salted key, is passed on as it comes, as a block named by its key.
    """
    limit = 1 << 16
    held_keys, held_nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_run: int | None = None
    known: set[int] = set()

    def batch_of(blocks: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(nodes)], names=["block", "node"])

    def runs(key: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch | None:
        keep = np.ones(len(key), dtype=bool)
        keep[1:] = (key[1:] != key[:-1]) | (nodes[1:] != nodes[:-1])
        key, nodes = key[keep], nodes[keep]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        sizes = np.diff(np.append(starts, len(key)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        if not len(starts):
            return None
        sums = np.append(_U64(0), np.cumsum(K.mix(nodes.view(np.uint64))))
        names = K.mix((sums[starts + sizes] - sums[starts]) * _U64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64)).view(np.int64)
        _, one = np.unique(names, return_index=True)
        one = np.array([k for k in one.tolist() if int(names[k]) not in known], dtype=np.int64)
        if len(known) < 200_000:  # what is not known is given again, and made distinct later
            known.update(names[one].tolist())
        if not len(one):
            return None
        return batch_of(np.repeat(names[one], sizes[one]), nodes[K.expand(starts[one], sizes[one])])

    for batch in batches:
        key, salt, nodes = (batch.column(k).to_numpy() for k in range(3))
        if salt.any():
            yield batch_of(key[salt > 0], nodes[salt > 0])
            key, nodes = key[salt == 0], nodes[salt == 0]
        key, nodes = np.append(held_keys, key), np.append(held_nodes, nodes)
        if long_run is not None and len(key):
            n = int(np.searchsorted(key != long_run, True)) if key[-1] != long_run else len(key)
            if n:
                yield batch_of(key[:n], nodes[:n])
            key, nodes = key[n:], nodes[n:]
            long_run = long_run if not len(key) else None
        if len(key):
            cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            if cut and (out := runs(key[:cut], nodes[:cut])) is not None:
                yield out
            held_keys, held_nodes = key[cut:], nodes[cut:]
            if len(held_keys) > limit:
                long_run = int(held_keys[0])
                yield batch_of(held_keys, held_nodes)
                held_keys, held_nodes = held_keys[:0], held_nodes[:0]
        else:
            held_keys, held_nodes = key, nodes
    if len(held_keys) and (out := runs(held_keys, held_nodes)) is not None:
        yield out


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ``WINDOW_ROWS`` rows or ``WINDOW_BYTES``, each of whole cells, which the rows are ordered by."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and (rows >= WINDOW_ROWS or size >= WINDOW_BYTES):
            last = held[-1].column(0)[-1].as_py()
            same = batch.column(0).to_numpy() == last
            n = len(same) if same.all() else int(np.argmin(same))
            if n:
                held.append(batch.slice(0, n))
            if n < len(same):
                yield pa.Table.from_batches(held).combine_chunks()
                batch, held, rows, size = batch.slice(n), [], 0, 0
            else:
                continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _within(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the cells, and the cell's number of each row."""
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    lengths = np.diff(np.append(starts, len(cells)))
    return starts, lengths, np.repeat(np.arange(len(starts)), lengths)


def _small_pairs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every two rows of cells that are one leaf of a tree (``FANOUT`` members at most)."""
    small = lengths <= FANOUT
    rows = K.expand(starts[small], lengths[small])
    after = np.repeat((starts + lengths)[small], lengths[small]) - rows - 1
    return np.repeat(rows, after), K.expand(rows + 1, after)


def _bitmap_pairs(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, column: pa.Array, threshold: int) -> np.ndarray:
    """Which pairs may link by their bitmaps, as ``SignatureTree.possible`` tells of leaves."""
    keep = np.zeros(len(a), dtype=bool)
    near = np.flatnonzero(100 * np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]))
    raw, offs = K.buffers(column)
    words, at, length = raw.view(np.uint64), offs[:-1] // 8, np.diff(offs) // 8
    width = np.minimum(length[a[near]], length[b[near]])
    for w in np.unique(width).tolist():
        these = near[width == w]
        used, place = np.unique(np.append(a[these], b[these]), return_inverse=True)
        maps = np.array([fold(words[at[k] : at[k] + length[k]], w) for k in used.tolist()]).reshape(len(used), w)
        for k in range(0, len(these), FRONT):
            i, j = place[k : min(k + FRONT, len(these))], place[len(these) + k : len(these) + min(k + FRONT, len(these))]
            one, two = sizes[used[i]], sizes[used[j]]
            left = one - np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1, dtype=np.int64)
            right = two - np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1, dtype=np.int64)
            keep[these[k : k + FRONT]] = (100 + threshold) * np.minimum(left, right) >= threshold * (one + two)
    return keep


def _overlaps(cell: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, shared n-grams) of the rows of the same cell that share any; arrays go by n-gram."""
    order = np.lexsort((rows, values, cell))
    cell, rows, values = cell[order], rows[order], values[order]
    codes, n = [np.zeros(0, np.int64)], int(rows.max()) + 1 if len(rows) else 1
    for d in range(1, FANOUT):
        same = np.flatnonzero((cell[d:] == cell[:-d]) & (values[d:] == values[:-d]))
        if not len(same):
            break
        codes.append(rows[same] * n + rows[same + d])
    code, shared = np.unique(np.concatenate(codes), return_counts=True)
    return code // n, code % n, shared


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest one that is connected to it by pairs."""
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
    return label


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Edges from the members of each component of pairs to its smallest one."""
    names, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(pairs.shape)
    least = _components(len(names), place[:, 0], place[:, 1])
    own = np.flatnonzero(least != np.arange(len(names)))
    return np.column_stack([names[own], names[least[own]]])


def _bands(sizes: np.ndarray, words: np.ndarray, threshold: int) -> Iterator[np.ndarray]:
    """For each width of bitmaps (``words`` of 64 bits) the sets of this width and the wider ones that may link with them.

    A tree folds its bitmaps to the narrowest, and in that of a short text all long ones look alike.
    """
    for width in np.unique(words).tolist():
        at = np.flatnonzero((words >= width) & (threshold * sizes <= 6400 * width))
        if len(at) > 1:
            yield at


def _candidates(cells: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) between labels that connect what may link, by bitmaps. cells: cell, node, side, label, n, map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for table in _tables(batches):
            side, label, sizes = (table.column(c).to_numpy() for c in ("side", "label", "n"))
            maps = table.column("map").combine_chunks()
            maps = maps.chunk(0) if isinstance(maps, pa.ChunkedArray) else maps
            starts, lengths, _ = _within(table.column("cell").to_numpy())
            a, b = _small_pairs(starts, lengths)
            a, b = (x[(label[a] != label[b]) & (side[a] != side[b])] for x in (a, b))
            keep = _bitmap_pairs(a, b, sizes, maps, threshold)
            found = [np.column_stack([label[a[keep]], label[b[keep]]])]
            raw, offs = K.buffers(maps)
            for x, m in zip(starts[lengths > FANOUT].tolist(), lengths[lengths > FANOUT].tolist(), strict=True):
                for at in _bands(sizes[x : x + m], np.diff(offs[x : x + m + 1]) // 8, threshold):
                    at += x
                    bitmaps = [raw[offs[k] : offs[k + 1]].view(np.uint64) for k in at.tolist()]
                    edges = np.array(links(sizes[at], bitmaps, threshold, None, side[at], labels=label[at]), dtype=np.int64).reshape(-1, 2)
                    found.append(label[at[edges]])
            fresh = [p for p in map(tuple, _stars(np.concatenate(found)).tolist()) if p not in done]
            if len(done) < 500_000:  # only spares repeats, which are made distinct later
                done.update(fresh)
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in fresh]), pa.array([p[1] for p in fresh])], names=["a", "b"])

    n = common.partitions(cells.sparkSession)
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _exact(cells: DataFrame, threshold: int, what: str) -> DataFrame:
    """Exact links of cells. cells: cell, node, side, label, copies, values.

    ``forest``: (a, b, 0), edges between labels that connect what links. ``count``: these, and
    (node, node, the documents of other sets it links with). ``pairs``: (a, b, shared) of every link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            nodes, side, label, copies = (table.column(c).to_numpy() for c in ("node", "side", "label", "copies"))
            column = table.column("values").combine_chunks()
            raw, offs = K.buffers(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
            values, offs = raw.view(np.uint64), offs // 8
            sizes = np.diff(offs)
            starts, lengths, number = _within(table.column("cell").to_numpy())
            small = np.flatnonzero(lengths[number] <= FANOUT)
            a, b, both = _overlaps(np.repeat(number[small], sizes[small]), np.repeat(small, sizes[small]), values[K.expand(offs[small], sizes[small])])
            linked = (100 * both >= threshold * (sizes[a] + sizes[b] - both)) & (side[a] != side[b])
            a, b, both = [a[linked]], [b[linked]], [both[linked]]
            edges = [np.column_stack([label[a[0]], label[b[0]]])]
            for x, m in zip(starts[lengths > FANOUT].tolist(), lengths[lengths > FANOUT].tolist(), strict=True):
                texts = [values[offs[k] : offs[k + 1]] for k in range(x, x + m)]
                found = links(sizes[x : x + m], [bitmap(t) for t in texts], threshold, exact_counter(texts, threshold), side[x : x + m], what != "forest", label[x : x + m])
                found = x + np.array(found, dtype=np.int64).reshape(-1, 2)
                i, j = found.T
                if what == "pairs":
                    both.append(overlap_counter(texts)(i - x, j - x))
                a.append(i), b.append(j)
                if what == "count":
                    least = x + _components(m, i - x, j - x)
                    i, j = np.arange(x, x + m), least
                edges.append(np.column_stack([label[i], label[j]]))
            a, b = np.concatenate(a), np.concatenate(b)
            if what == "pairs":
                out = [nodes[a], nodes[b], np.concatenate(both)]
            else:
                edge = _stars(np.concatenate(edges))
                degree = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes)) if what == "count" else np.zeros(1)
                own = np.flatnonzero(degree)
                out = [np.append(edge[:, 0], nodes[own]), np.append(edge[:, 1], nodes[own]), np.append(np.zeros(len(edge), np.int64), degree[own].astype(np.int64))]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["a", "b", "links"])

    n = common.partitions(cells.sparkSession)
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, links long")


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after edges between labels have joined some."""
    joined = common.materialize(connected(edges), "joined")
    moved = labels.join(joined.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("label"))
    single = joined.join(labels, "node", "left_anti").select("node", F.col("component").alias("label"))
    return common.materialize(moved.unionByName(single), "labels")


def _chunk_of(salt: int = 0):
    return F.pmod(F.xxhash64("node", "group", F.lit(salt)), F.col("chunks"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the large groups that have several labels, with their labels."""
    labelled = members.join(labels.hint("merge"), "node", "left").select("group", "node", "weight", F.coalesce("label", "node").alias("label"))
    # the least and the greatest label tell whether there are several
    several = labelled.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("group")
    labelled = common.materialize(labelled, "labelled")
    several = common.materialize(several, "several")
    return common.materialize(common.join_small(labelled, several, "group"), "open")


def _counted(members: DataFrame, chunk: int, name: str = "chunks") -> DataFrame:
    """(group, number of chunks) by the members' weights."""
    return members.groupBy("group").agg(F.ceil(F.sum("weight") / F.lit(float(chunk))).cast("long").alias(name))


def _by_rounds(members: DataFrame, chunk: int, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label) of the components of groups, no matter how large a group is.

    members: group, node and weight, materialized; the first cells have their further columns too.
    ``edges_of`` takes cells (cell, node, side, label) and gives edges between labels. Small groups are a cell each. A large one is first
    cut into chunks, each a cell; then a few members of each component found so far meet;
    then all others meet with the members of the group's largest component and with each
    other, in pairs of chunks, unless they are connected already. So a group of near copies
    takes work in proportion to its members, and no pair of texts of different components
    is left out.
    """
    large = common.materialize(_counted(members, chunk).filter("chunks > 1"), "large")
    found = connected(edges_of(_first_cells(members, large)))
    labels = common.materialize(found.select("node", F.col("component").alias("label")), "labels")
    if common.is_empty(large):
        return labels

    big = common.materialize(common.join_small(members.select("group", "node", "weight"), large.select("group"), "group"), "big")
    several = _open(big, labels)
    if common.is_empty(several):
        return labels
    few = several.groupBy("group", "label", F.pmod(F.xxhash64("node"), F.lit(REPRESENTATIVES)).alias("k")).agg(F.min_by("node", F.struct("weight", "node")).alias("node"), F.min("weight").alias("weight"))
    few = common.materialize(few.drop("k"), "few")
    counted = common.join_small(few, common.materialize(_counted(few, chunk), "chunks"), "group")
    second = counted.select(F.xxhash64("group", _chunk_of(1)).alias("cell"), "node", F.col("node").alias("side"), "label")
    labels = _relabelled(labels, edges_of(second))

    several = _open(several.drop("label"), labels)
    if common.is_empty(several):
        return labels
    return _relabelled(labels, edges_of(_others(several, chunk)))


def _others(several: DataFrame, chunk: int) -> DataFrame:
    """Cells in which the members outside a group's largest component meet all members."""
    sizes = several.groupBy("group", "label").agg(F.sum("weight").alias("weight"))
    largest = sizes.groupBy("group").agg(F.max_by("label", F.struct("weight", "label")).alias("largest"))
    several = common.join_small(several, common.materialize(largest, "largest"), "group")
    several = several.withColumn("kind", F.col("label") == F.col("largest")).drop("largest")
    chunks = several.groupBy("group").agg(*(F.ceil(F.sum(F.when(F.col("kind") == kind, F.col("weight"))) / F.lit(float(chunk))).cast("long").alias(name) for kind, name in ((True, "inside"), (False, "outside"))))
    several = common.join_small(several, common.materialize(chunks, "chunks"), "group")
    own = F.pmod(F.xxhash64("node", "group"), F.when(F.col("kind"), F.col("inside")).otherwise(F.col("outside")))
    several = several.withColumn("own", own)
    side = F.when(F.col("kind"), -1 - F.col("own")).otherwise(F.col("own"))
    met = F.when(F.col("kind"), F.sequence(F.lit(0).cast("long"), F.col("outside") - 1)).otherwise(F.concat(F.sequence(F.lit(0).cast("long"), F.col("outside") - 1), F.transform(F.sequence(F.lit(0).cast("long"), F.col("inside") - 1), lambda j: -1 - j)))
    cells = several.select("group", "node", "label", side.alias("own"), F.explode(met).alias("other"))
    alone = F.col("own") == F.col("other")
    return cells.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", F.when(alone, F.col("node")).otherwise(F.col("own")).alias("side"), "label")


def _first_cells(members: DataFrame, large: DataFrame) -> DataFrame:
    """Cells of small groups, and of the chunks of large ones by themselves; further columns of members stay."""
    further = [c for c in members.columns if c not in ("group", "node", "weight")]
    counted = common.join_small(members, large, "group", "left")
    cell = F.when(F.col("chunks").isNull(), F.col("group")).otherwise(F.xxhash64("group", _chunk_of()))
    return counted.select(cell.alias("cell"), "node", F.col("node").alias("side"), F.col("node").alias("label"), *further)


def _cross(members: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of every two different chunks of the large groups."""
    big = common.join_small(members.select("group", "node"), large, "group").join(labels.hint("merge"), "node", "left")
    cells = big.select("group", "node", F.coalesce("label", "node").alias("label"), _chunk_of().alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")).filter("own <> other")
    return cells.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", F.col("own").alias("side"), "label")


def _filled(cells: DataFrame, payload: DataFrame) -> DataFrame:
    """Cells with what belongs to their nodes; few cells, as those of later rounds, go to where that is."""
    cells = common.materialize(cells, "cells")
    if cells.measured["rows"] <= BROADCAST_ROWS:
        return payload.join(F.broadcast(cells), "node")
    return cells.join(payload.hint("merge"), "node")


class _Prepared:
    """What all forms of the join start from."""

    def __init__(self, docs: DataFrame, ngram: int, threshold: int, chunk: int):
        self.ngram, self.threshold, self.chunk = ngram, threshold, chunk
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        described = common.materialize(_described(texts, ngram), "described")
        self.rows = described.filter("piece IS NULL").select("doc_id", "n_shingles", "node")
        real = described.filter("doc_id IS NOT NULL AND n_shingles > 0")
        ids = real.groupBy("node", "doc_id").agg(F.any_value("n_shingles").alias("n"), F.any_value("map").alias("map"), F.count("*").alias("rows"))
        nodes = ids.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("map").alias("map"), F.max("rows").alias("rows"))
        self.nodes = common.materialize(nodes, "nodes", most=F.max("copies"), rows_of_one=F.max("rows"))

        n = common.partitions(docs.sparkSession)
        keys = _keys(texts.filter("doc_id IS NOT NULL"), ngram, threshold, _sketch(described))
        blocks = common.materialize(keys.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(_blocks, "block long, node long"), "blocks")
        members = common.materialize(blocks.distinct().select(F.col("block").alias("group"), "node", F.lit(1.0).alias("weight")), "members")
        maps = self.nodes.select("node", "n", "map")
        clusters = _by_rounds(members, chunk, lambda cells: _candidates(_filled(cells, maps).select("cell", "node", "side", "label", "n", "map"), threshold))

        # the n-grams of the sets of clusters, from one text of each
        chosen = common.materialize(clusters.join(self.nodes.select("node", "doc_id", "copies", "n").hint("merge"), "node").withColumnRenamed("label", "cluster"), "chosen")
        values = _values(_wanted(texts, chosen).select("text", "node", "copies", "cluster"), ngram)
        if (self.nodes.measured["rows_of_one"] or 0) > 1:
            values = values.dropDuplicates(["node"])
        self.values = common.materialize(values, "values")
        weight = F.greatest(F.lit(1.0), F.length("values") / F.lit(8 * 512.0))
        self.members = self.values.select(F.col("cluster").alias("group"), "node", weight.alias("weight"), "copies", "values")
        sized = chosen.select(F.col("cluster").alias("group"), F.greatest(F.lit(1.0), F.col("n") / F.lit(512.0)).alias("weight"))
        self.large = common.materialize(_counted(sized, chunk).filter("chunks > 1"), "large")

    def exact(self, cells: DataFrame, what: str) -> DataFrame:
        """Links of cells; the first ones have their n-grams already, and others get them here."""
        filled = cells if "values" in cells.columns else _filled(cells, self.values)
        return _exact(filled.select("cell", "node", "side", "label", "copies", "values"), self.threshold, what)

    def same_ids(self) -> DataFrame | None:
        """Edges between the sets of a doc_id that several rows with different sets have; None if there are none."""
        real = self.rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
        several = real.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a <> most").select("doc_id", "a")
        if several.isEmpty():
            return None
        several = common.materialize(several, "several")
        return common.materialize(common.join_small(real, several, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"), "same_ids")


def _marks(chosen: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of hashed doc_ids, made in PIECES."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    width = bits // PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(0).to_numpy()
            for k in np.unique(place // width).tolist():
                pieces.setdefault(k, np.zeros(width, dtype=bool))[place[place // width == k] % width] = True
        for k, piece in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(piece).tobytes()], pa.binary())], names=["piece", "bits"])

    placed = chosen.select(at.alias("at")).repartition(PIECES, F.floor(F.col("at") / F.lit(width)))
    out = np.zeros((PIECES, width // 8), dtype=np.uint8)
    for row in placed.mapInArrow(run, "piece long, bits binary").toArrow().to_pylist():
        out[row["piece"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.ravel()


def _marked(texts: DataFrame, chosen: DataFrame, bits: int) -> DataFrame:
    """The texts whose doc_id is marked, which are the chosen ones and a few others."""
    shared = texts.sparkSession.sparkContext.broadcast(_marks(chosen, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1)).select(["doc_id", "text"])

    placed = texts.filter("doc_id IS NOT NULL").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    return placed.mapInArrow(run, "doc_id long, text string")


def _wanted(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen sets with the texts of their doc_ids; texts that are not wanted stay out of the shuffle.

    Few chosen are broadcast, of more a bitmap. What it lets through besides is dropped by the join,
    and beyond MARK_BITS / 4 chosen it would spare too little.
    """
    rows = chosen.measured["rows"]
    if BROADCAST_ROWS < rows <= MARK_BITS // 4:
        bits = max(1 << 16, min(MARK_BITS, 1 << (16 * rows - 1).bit_length()))
        texts = _marked(texts, chosen, bits)
    return common.join_small(texts, chosen, "doc_id", rows=BROADCAST_ROWS)


def _values(docs: DataFrame, ngram: int) -> DataFrame:
    """The n-gram hashes of the texts that have the set they are wanted for (a doc_id may repeat with other texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_numpy()
            for a, b, values, first in sets(batch.column(0), ngram):
                right = np.flatnonzero(_node_hashes(values, first) == wanted[a:b])
                packed = [values[first[k] : first[k + 1]].tobytes() for k in right.tolist()]
                if packed:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(a + right)) for c in ("node", "copies", "cluster")), pa.array(packed, pa.binary())], names=["node", "copies", "cluster", "values"])

    return docs.mapInArrow(run, "node long, copies long, cluster long, values binary")


def _by_node(rows: DataFrame, told: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows joined with what is told of their node; the nodes of very many documents are broadcast, as they are few."""
    if (nodes.measured["most"] or 0) <= HOT_KEY:
        return rows.join(told, "node", "left")
    often = common.materialize(told.join(nodes.filter(F.col("copies") > HOT_KEY).select("node"), "node"), "often")
    names = [c for c in told.columns if c != "node"]
    found = common.join_small(rows, often.select("node", *(F.col(c).alias(f"often_{c}") for c in names), F.lit(True).alias("often")), "node", "left")
    key = F.when(F.col("often").isNull(), F.col("node"))  # hot rows have no key in the second join
    found = found.withColumn("key", key).join(told.withColumnRenamed("node", "key"), "key", "left")
    return found.select(*rows.columns, *(F.coalesce(f"often_{c}", c).alias(c) for c in names))


def join(docs: DataFrame, ngram: int = NGRAM, threshold: int = THRESHOLD, chunk: int = CHUNK, count: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every row.

    With ``count`` also n_links, the number of other documents (doc_ids with their sets) that the
    row's document links with.
    """
    own = _Prepared(docs, ngram, threshold, chunk)
    if count:
        inside = common.materialize(own.exact(_first_cells(own.members, own.large), "count"), "links")
        labels = common.materialize(connected(inside.filter("a <> b").select("a", "b")).select("node", F.col("component").alias("label")), "labels")
        if not common.is_empty(own.large):
            across = common.materialize(own.exact(_cross(own.members, own.large, labels), "count"), "links")
            labels = _relabelled(labels, across.filter("a <> b").select("a", "b"))
            inside = inside.unionByName(across)
        others = inside.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    else:
        labels = _by_rounds(own.members, chunk, lambda cells: own.exact(cells, "forest").select("a", "b"))
    if (repeated := own.same_ids()) is not None:
        labels = _relabelled(labels, _labelled_edges(repeated, labels))
    nodes = own.nodes.select("node", "doc_id", "copies")
    named = nodes.join(labels, "node", "left").select("node", "doc_id", "copies", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    told = named.join(least, "label").select("node", "component_id", (F.col("copies") - 1).alias("n_links"))
    if count:
        told = told.join(others, "node", "left").select("node", "component_id", (F.col("n_links") + F.coalesce("links", F.lit(0))).alias("n_links"))
    # what is told of sets that have neither links nor copies follows from the row
    told = common.materialize(told, "told")
    real = F.col("doc_id").isNotNull()
    rows = own.rows.withColumn("node", F.when(real & (F.col("n_shingles") > 0), F.col("node")))
    found = _by_node(rows, told, own.nodes)
    columns = ["doc_id", "n_shingles", F.when(real, F.coalesce("component_id", "doc_id")).alias("component_id")]
    if count:
        columns.append(F.when(real, F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return found.select(*columns)


def _labelled_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between nodes as edges between their labels."""
    for end in ("a", "b"):
        edges = edges.join(labels.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return edges.select("a", "b").filter("a <> b")


def pairs(docs: DataFrame, ngram: int = NGRAM, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """doc_a, doc_b, shared (n-grams) and similarity of every two documents that link, doc_a < doc_b.

    The rows are as many as the links: m(m - 1) / 2 for m copies. A doc_id with several
    sets is given once for each of them that links.
    """
    own = _Prepared(docs, ngram, threshold, chunk)
    nothing = own.nodes.select("node", F.col("node").alias("label")).limit(0)
    cells = _first_cells(own.members.select("group", "node", "weight"), own.large).unionByName(_cross(own.members, own.large, nothing))
    found = common.materialize(own.exact(cells, "pairs").withColumnRenamed("links", "shared"), "pairs")
    same = own.nodes.filter("copies > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("n").alias("shared"))
    found = found.unionByName(same)
    ids = own.rows.filter("doc_id IS NOT NULL AND n_shingles > 0").distinct()
    for end in ("a", "b"):
        found = found.join(ids.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("doc_id").alias(f"doc_{end}")), end)
    # two nodes are met in one order only, so the documents are put in theirs
    found = found.filter("(a = b AND doc_a < doc_b) OR (a <> b AND doc_a <> doc_b)")
    similarity = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return found.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "shared", similarity.alias("similarity"))
