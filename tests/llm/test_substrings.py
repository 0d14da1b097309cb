import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from glosswork.llm import substring_dedup
from glosswork.llm.hashing import WordHashes, rolled, sliding
from glosswork.llm.sketches import repeated, sketch
from glosswork.llm.substring_dedup import remove_repeats


def test_rolled_and_sliding():
    words = [bytes([97 + i % 7]) for i in range(200)]
    h = WordHashes(4).of(words)
    for size in (1, 3, 8, 9, 35):
        runs = rolled(h, size)
        assert len(runs) == 201 - size
        groups = defaultdict(set)
        for i, x in enumerate(runs.tolist()):
            groups[tuple(words[i : i + size])].add(x)
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)
        assert sliding(h, size, np.minimum).tolist() == [min(h[i : i + size].tolist()) for i in range(201 - size)]


def test_sketch_never_misses_a_repeat(spark):
    rng = np.random.default_rng(1)
    keys = np.concatenate([np.arange(5000), rng.integers(0, 5000, 700)])
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5)
    bits = sketch(df, lambda b: b.column(0).to_numpy().astype(np.uint64), rows=2, width=1 << 17)
    unique, times = np.unique(keys, return_counts=True)
    told = repeated(bits, unique.astype(np.uint64), 1 << 17)
    assert told[times > 1].all() and told[times == 1].mean() < 0.05
    powers = sketch(df, lambda b: b.column(0).to_numpy().astype(np.uint64), rows=1, width=1 << 17, powers=True)[0]
    assert powers.max() >= 2 and (powers > 0).sum() > 4000


def brute(docs, size):
    places = defaultdict(int)
    split = [(t or "").encode().split() for _, t in docs]
    for words in split:
        for i in range(len(words) - size + 1):
            places[tuple(words[i : i + size])] += 1
    out = []
    for (doc_id, _), words in zip(docs, split):
        gone = set()
        for i in range(len(words) - size + 1):
            if places[tuple(words[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((doc_id, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    for size, pool in ((4, 6), (35, 3000), (7, 40)):
        passages = [[f"w{rng.randrange(pool)}" for _ in range(size + rng.randint(-2, 30))] for _ in range(6)]
        docs = []
        for i in range(120):
            words = [f"w{rng.randrange(pool)}" for _ in range(rng.randint(0, 90))]
            if rng.random() < 0.6:
                at = rng.randint(0, len(words))
                words[at:at] = rng.choice(passages)[rng.randint(0, 3) :]
            docs.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
        docs += [(500, None), (501, ""), (502, " \n "), (3, docs[3][1]), (3, docs[3][1]), (None, docs[4][1]), (None, "short"), (600, "same " * 50), (601, docs[7][1].upper())]
        df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int").repartition(7)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in remove_repeats(df, size=size).collect()), key=str)
        assert got == brute(docs, size), size


def test_repeats_across_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = [(i, "a b c d e " * (i % 4) + f"x{i} y z") for i in range(60)] + [(99, "x1 y z a b")]
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), size=3).collect()), key=str)
        assert got == brute(docs, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_of_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_task_tells_of_a_document_once(monkeypatch):
    """Windows come stretch by stretch, more of them than are gathered at a time; a document's are one row with one range."""
    monkeypatch.setattr(substring_dedup, "FLUSH_HITS", 1000)
    rng, rows = random.Random(3), []
    for stretch in range(60):
        for h, i in sorted((rng.randrange(2**62), i) for i in range(10)):
            rows += [(h, 1, substring_dedup.OPEN, d, 7, 10 * stretch + i, 1) for d in range(20)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(substring_dedup._WINDOWS.names, r)) for r in rows[k : k + 450]], substring_dedup._WINDOWS) for k in range(0, len(rows), 450)]
    out = [r for b in substring_dedup._matched(iter(batches)) for r in b.to_pylist()]
    assert out == [{"doc_id": d, "text_hash": 7, "starts": [0], "counts": [600]} for d in range(20)]
