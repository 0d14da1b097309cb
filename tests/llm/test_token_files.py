import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glosswork.llm import wavelet
from glosswork.llm.token_files import read_tokens, token_counts, token_positions, tokens_at, write_tokens
from glosswork.llm.word_tokens import WordEncoder

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = list(" \n\t\r  abAB12.,'’\x85\x1c\x0béßΣσİ漢😀́_-|×ªµ²ÀŸ\xa0") + ["<|endoftext|>", "'s", " \n", "'ll", "<|startoftext|>", "<|"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    encoder, rng = WordEncoder(PATH, limit=500), random.Random(1)
    assert encoder.splits and encoder.fast
    plain = [chr(c) for c in [*range(33, 127), *range(0xC0, 0xD7)]]
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choice(plain if rng.random() < 0.2 else "etaoinshrdlu") for _ in range(rng.randint(1, 20))) for _ in range(20)) for _ in range(500)]
    for text in [*texts, "a" * 20_000, "!" * 5000, "ab" * 9000, "word " * 300_000]:
        got = [x for part in encoder.parts(text.encode(), rng.choice([1, 7, 1 << 20])) for x in part.tolist()]
        assert got == ids(library, text), text[:60]


@pytest.mark.parametrize(("n", "block"), [(0, 64), (1, 64), (63, 64), (64, 64), (1000, 64), (1000, 512), (70_000, 1 << 19)])
def test_a_shard_answers_as_its_ids_do(n, block, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", block)
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.zipf(1.3, n), 300).astype(np.uint16)
    shard = wavelet.Shard(io.BytesIO(wavelet.build(tokens, 9, pa.record_batch({"doc_id": [1]}))), held=3)
    assert (shard.ids() == tokens).all() and shard.documents().to_pydict() == {"doc_id": [1]}
    places = rng.integers(0, n, 40) if n else np.empty(0, np.int64)
    assert (shard.access(places) == tokens[places]).all()
    for token in (1, 2, 5, 300, 299, 511, 600, -1):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert shard.count(token) == (tokens == token).sum() and shard.count(token, a, b) == (tokens[a:b] == token).sum()
        assert (shard.occurrences(token) == np.flatnonzero(tokens == token)).all() and (shard.occurrences(token, a, b) == a + np.flatnonzero(tokens[a:b] == token)).all()


@pytest.mark.parametrize("shard_tokens", [7, 500, 1 << 22])
def test_documents_read_back_against_brute_force(spark, library, shard_tokens):
    rng = random.Random(3)
    texts = [None, "", " ", "a<|endoftext|>b", "word, " * 3000, *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 90))) for _ in range(120))]
    rows = [(3 * i - 50, t, "x") for i, t in enumerate(texts)] + [(None, "of no id", "y"), (4, texts[18], "z")]
    rng.shuffle(rows)
    if shard_tokens == 7:
        rows = [r for r in rows if len(r[1] or "") < 100]
    manifest = write_tokens(spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(3), PATH, shard_tokens=shard_tokens)
    ordered, want, start = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), [], 0
    stream: list[int] = []
    for doc_id, text, _ in ordered:
        own = [*ids(library, text), 2]
        want.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
        stream += own
    got = sorted(map(tuple, read_tokens(manifest).collect()), key=lambda r: r[1])
    assert got == want
    assert all(r.n_tokens <= shard_tokens for r in manifest.collect())
    asked = [2, 320, stream[0], 49_407]
    assert {r.token: r.n for r in token_counts(manifest, asked).collect()} == {t: stream.count(t) for t in asked}
    found = token_positions(manifest, [2, 49_407]).collect()
    assert sorted((r.token, r.position) for r in found) == sorted((t, i) for i, t in enumerate(stream) if t in (2, 49_407))
    some = tokens_at(manifest, 5, 40).collect()
    assert [r.token for r in sorted(some)] == stream[5:40]


def test_no_rows_and_ids_of_text(spark, library):
    assert read_tokens(write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0
    manifest = write_tokens(spark.createDataFrame([("b", "two words"), ("a", "")], "doc_id string, text string"), PATH)
    assert sorted(tuple(r)[:3] for r in read_tokens(manifest, "string").collect()) == [("a", 0, 1), ("b", 1, 1 + len(ids(library, "two words")))]
