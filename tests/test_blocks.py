"""Islands that lie across Arrow batches, and short ones side by side against each by itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from glosswork.operators.alignment import NAMES, _legacy_block, blocks, decided
from glosswork.operators.matching import _matched_block


def spans(seed):
    r = random.Random(seed)
    rows = [(d, s, s + r.randint(1, 9), r.choice([0, 1, 2, None]), r.random() < 0.5) for d in range(12) for s in (r.randint(-5, 60) for _ in range(r.randint(1, 30)))]
    return sorted(rows, key=lambda x: (*x[:3], x[3] is not None, x[3] or 0, x[4]))


def batches(rows, size, nested=False):
    for at in range(0, len(rows), size):
        d, s, e, lab, gold = zip(*rows[at : at + size], strict=True)
        docs = pa.array(d, pa.int64())
        docs = pa.StructArray.from_arrays([pa.array(["v"] * len(d)), docs], names=["version", "doc_id"]) if nested else docs
        yield pa.RecordBatch.from_arrays([docs, pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(lab, pa.int32()), pa.array(gold)], names=["doc_id", "s", "e", "lab", "_gold"])


def said(found, decide):
    out = []
    for block in found:
        rows = [(x["doc_id"]["doc_id"] if isinstance(x["doc_id"], dict) else x["doc_id"], x["s"], x["e"], x["lab"], x["_gold"]) for x in block.rows.to_pylist()]
        out += [(NAMES[k], *(str(rows[i]) if i >= 0 and NAMES[k][0] != "X" else "" for i in (g, p))) for k, g, p in zip(*(x.tolist() for x in decide(block)), strict=True)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("decide", [lambda b, n: decided(b, True, n), lambda b, n: decided(b, False, n), _legacy_block, lambda b, n: _matched_block(b)], ids=["two tiers", "labels", "legacy", "wrong labels"])
def test_batches_and_short_islands_make_no_difference(seed, decide):
    rows = spans(seed)
    whole = said(blocks(batches(rows, 10_000)), lambda b: decide(b, 48))
    for size in (1, 3, 50):
        assert said(blocks(batches(rows, size, size == 3)), lambda b: decide(b, 0)) == whole


def test_an_island_is_held_until_the_next_begins():
    rows = [(1, 0, 100, 0, True), *((1, i, i + 1, 1, False) for i in range(1, 50)), (1, 100, 101, 0, True), (2, 5, 6, 0, True)]
    sizes = [np.diff(np.append(b.begins, len(b.s))).tolist() for b in blocks(batches(rows, 4))]
    assert [n for x in sizes for n in x] == [50, 1, 1]
