import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import bpe, grammar

from .helpers import documents, empty, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    ranks, _ = bpe.tokenizer(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def test_digests(spark):
    enc = reference()
    df = documents(spark)
    want = []
    for r in df.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(df, RANKS).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(empty(spark), RANKS).collect() == []


def test_encode_and_decode_columns(spark):
    df = documents(spark)
    out = bpe.decode(bpe.encode(df, RANKS), RANKS)
    assert out.columns == [*df.columns, "token_ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in out.collect())


def test_long_pretokens_and_small_cache():
    rng, enc, ranks = random.Random(2), reference(), bpe.tokenizer(RANKS)[0]
    pieces = ["".join(rng.choice("abthein") for _ in range(n)) for n in (513, 700, 4000)] + ["a" * 3000, "ab" * 300]
    for piece, ids in zip(pieces, ranks.merge([p.encode() for p in pieces]), strict=True):
        assert ids.tolist() == enc.encode_ordinary(piece)
    import pyarrow as pa

    from sparkloom.llm import textkernel as K

    small = bpe.CachedEncoder(ranks.merge, limit=20)
    rows = [t or "" for t in texts()]
    for a, b, raw, offs in K.slices(pa.array(rows), 300):
        ids, first = small.rows(raw, offs)
        for i in range(b - a):
            assert ids[first[i] : first[i + 1]].tolist() == enc.encode_ordinary(rows[a + i])


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for base, n in ((50257, 20_000), (300, 5000), (70_000, 3000), (10, 0), (10, 1), (5, 4000)):
        ids = np.minimum(rng.zipf(1.3, n), base) - 1
        counts = np.array([n])
        shard = grammar.Shard(grammar.pack([None], counts, ids, base))
        assert shard.ids().tolist() == ids.tolist() and shard.doc_ids == [None]
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert shard.ids(a, b).tolist() == ids[a:b].tolist()
        if n >= 4000:
            assert len(shard.symbols) < n and len(shard.lengths) > base


def test_grammar_goes_on_until_no_pair_is_frequent():
    """A long passage that repeats becomes one symbol, however many rounds that takes."""
    rng = np.random.default_rng(4)
    passage = rng.permutation(2000)[:1500].astype(np.int32)
    ids = np.concatenate([np.append(passage, 2000 + k) for k in range(40)]).astype(np.int32)
    symbols, left, right, rounds = grammar.compress(ids, 3000, 20_000)
    pairs, counts = np.unique(symbols[:-1].astype(np.int64) << 32 | symbols[1:], return_counts=True)
    assert counts.max() < grammar.MIN_COUNT and len(rounds) > 8 and len(symbols) == 80
    lengths = np.ones(3000 + len(left), dtype=np.int64)
    for a, b in zip(rounds[:-1], rounds[1:], strict=True):
        lengths[3000 + a : 3000 + b] = lengths[left[a:b]] + lengths[right[a:b]]
    assert lengths.max() == 1500 and lengths[symbols].sum() == len(ids)


def test_files(spark, tmp_path):
    library = Tokenizer.from_file(LIBRARY)
    df = documents(spark)
    df = df.unionByName(spark.createDataFrame([(900, "a <|endoftext|> b", "en", "s", 0, 0.5, 7)], df.schema))
    got = [tuple(r) for r in grammar.write_and_read(df, LIBRARY).collect()]
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for d, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, grammar.END]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert grammar.write_and_read(empty(spark), LIBRARY).collect() == []


def test_small_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, f"document {k} " * (k % 7)) for k in range(60)], "doc_id long, text string")
    grammar.write(df, LIBRARY, str(tmp_path / "s"), shard_ids=40)
    got = grammar.read(spark, str(tmp_path / "s")).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    payload = spark.read.parquet(str(tmp_path / "s")).first()["payload"]
    shard = grammar.Shard(bytes(payload))
    assert np.concatenate([shard.document(k) for k in range(len(shard.doc_ids))]).tolist() == shard.ids().tolist()
