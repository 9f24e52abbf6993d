import random

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN

from sparkloom.llm import textkernel as K

from .helpers import texts, words


def test_pretokens_equal_the_pattern():
    rng, pattern = random.Random(1), regex.compile(PATTERN)
    letters = "ab se'tlvrmd  \n\t12é,.!'ñ 　ß日\u0085"
    for _ in range(100):
        rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) if rng.random() < 0.9 else None for _ in range(40)]
        for a, b, raw, offs in K.slices(pa.array(rows, pa.string()), 200):
            starts, ends, first = K.pretokens(raw, offs)
            for i in range(b - a):
                got = [raw[starts[j] : ends[j]].tobytes().decode() for j in range(first[i], first[i + 1])]
                assert got == pattern.findall(rows[a + i] or "")


def test_words_and_shingles():
    rows = texts()
    for width in (1, 4, 5):
        for a, b, raw, offs in K.slices(pa.array(rows, pa.string()), 500):
            starts, ends, first = K.words(raw, offs)
            values, sets = K.sorted_sets(*K.shingle_hashes(*K.word_hashes(raw, offs), width))
            for i in range(b - a):
                w = words(rows[a + i])
                assert [raw[starts[j] : ends[j]].tobytes().decode().lower() for j in range(first[i], first[i + 1])] == [x.lower() for x in w]
                want = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
                assert sets[i + 1] - sets[i] == len(want)


def test_hash_index():
    rng = np.random.default_rng(0)
    index, known = K.HashIndex(4), {}
    for _ in range(20):
        keys = np.setdiff1d(rng.integers(0, 5000, 300).astype(np.uint64), np.array(list(known), np.uint64))
        index.insert(keys, np.arange(len(keys)) + len(known))
        known.update({int(k): len(known) + i for i, k in enumerate(keys)} if False else dict(zip(keys.tolist(), (np.arange(len(keys)) + index.count - len(keys)).tolist(), strict=True)))
        asked = rng.integers(0, 6000, 500).astype(np.uint64)
        assert index.find(asked).tolist() == [known.get(int(k), -1) for k in asked]


def test_slices_of_sliced_arrays():
    column = pa.array(["ab", None, "", "cde", "f"]).slice(1, 3)
    raw, offs = K.buffers(column)
    assert raw.tobytes() == b"cde" and offs.tolist() == [0, 0, 0, 3]


def test_shingles_of_fewer_words_than_the_width():
    """Also where a whole slice has fewer words."""
    for count in (0, 1, 3):
        made, first = K.shingle_hashes(np.arange(1, count + 1, dtype=np.uint64), np.array([0, count, count]), 5)
        assert len(made) == min(count, 1) and first.tolist() == [0, min(count, 1), min(count, 1)]
