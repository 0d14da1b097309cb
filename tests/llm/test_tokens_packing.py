import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glosswork.llm.packing import best_fit, fit_counts, pack_documents
from glosswork.llm.token_counts import count_tokens
from glosswork.llm.tokens import Encoder

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = list(" \n\t\r  abAB12.,'’\x85\x1c\x0béß漢😀́_-|") + ["<|endoftext|>", "'s", " \n", "'ll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n, longest, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_fast_ids_equal_the_library(library):
    encoder = Encoder(PATH)
    assert encoder.fast
    for text in [*odd_texts(3000, 60), "a" * 20_000, "!" * 5000, " " * 5000, "word " * 300_000, "é" * 4000]:
        assert encoder.ids(text).tolist() == ids(library, text), text[:60]
    other = Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    assert other.fast is None and other.count("Some words") == 2


def test_counts_equal_the_library(spark, library):
    rng = random.Random(5)
    texts = [None, "", " ", "a<|endoftext|>b <|endo", "x" * 3000, "word " * 900, "\n" * 2500, "a b" * 1, *odd_texts(20, 4000), " ".join("w" * rng.randint(1, 400) for _ in range(30))]
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = count_tokens(df, PATH, huge_chars=700, step=600, overlap=150)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), n := len(ids(library, t)), n > 512) for i, t, _ in rows)
    assert got == want
    # Spaced texts are spliced; a text without a boundary ends as one chunk.
    chunks = {(r.doc_id, r.n_bytes): r.n_chunks for r in out.collect()}
    assert chunks[(5, 4500)] > 3 and chunks[(None, 3000)] == 1


def test_counts_of_no_rows(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_best_fit_takes_the_smallest_gap():
    sequence, offset, opened = best_fit(np.array([6, 7, 3, 4, 4, 10]), 10)
    assert opened == 4  # 34 ids of 10 a sequence
    used = defaultdict(list)
    for s, o, n in zip(sequence, offset, [6, 7, 3, 4, 4, 10]):
        used[s].append((o, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 10


def test_best_fit_against_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 65, rng.integers(1, 200))
        free = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(64 - n)
        assert best_fit(lengths, 64)[2] == len(free)


@pytest.mark.parametrize("shard_docs", [65_536, 7])
def test_packing_is_whole_and_gapless(spark, library, shard_docs):
    texts = [None, "", "same text here", "same text here", *odd_texts(30, 900), "many words " * 700]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(2, texts[2], "z"), (None, "null id", "z")]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece string"), PATH, capacity=256, shard_docs=shard_docs).collect()
    want = defaultdict(int)
    for doc_id, text, _ in rows:
        found = [*ids(library, text), 0]
        first = len(found) % 256 or 256
        cuts = [0, *range(first, len(found) + 1, 256)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc_id, piece, a, b - a, zlib.crc32(np.array(found[a:b], "<u4").tobytes()))] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in out:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(k[3] * n for k, n in want.items())
    assert shard_docs == 7 or len(places) <= -(-total // 256) + 1


def test_counts_alone_give_the_same_fit():
    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths = rng.integers(1, 65, rng.integers(0, 400))
        sequence, offset, opened = best_fit(lengths, 64)
        values, counts = np.unique(lengths, return_counts=True)
        runs, number = fit_counts(values, counts, 64)
        assert number == opened
        for value in values:
            rank = np.arange((lengths == value).sum())
            hit = runs[runs[:, 0] == value]
            hit = hit[np.searchsorted(hit[:, 1], rank, side="right") - 1]
            assert (hit[:, 2] + (rank - hit[:, 1]) // hit[:, 3] == sequence[lengths == value]).all()
            assert (hit[:, 4] + (rank - hit[:, 1]) % hit[:, 3] * value == offset[lengths == value]).all()


def test_ranges_give_one_best_fit(spark):
    texts = [None] * 30 + ["equal rows"] * 40 + odd_texts(60, 900)
    df = spark.createDataFrame([(i if i >= 70 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, many = (sorted(map(tuple, pack_documents(df, PATH, capacity=256, shard_docs=n).collect()), key=str) for n in (65_536, 9))
    assert one == many
    firsts = np.array([r[3] for r in one if r[1] == 0])
    assert len({r[5] for r in one}) == best_fit(firsts, 256)[2] + sum(r[1] > 0 for r in one)


def test_packing_of_no_rows(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
