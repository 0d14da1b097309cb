import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glosswork.llm import language_model as lm
from glosswork.llm.queries import tokenizer_path
from glosswork.llm.tokens import Encoder

ROWS = [(i, " ".join(["The", "cat", "sat", f"w{i % 7}", "on"] * (1 + i % 9))) for i in range(60)] + [(60, None), (61, ""), (62, "x" * 9000), (62, "x" * 9000), (None, "The  dog\n"), (63, "new " * 300), (64, "a    b"), (65, "naïve größer été")]


def lower(text):
    return (text or "").encode().lower().split()


def in_training(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def text_ids(encoder, text):
    return [int(x) for w in lower(text) for x in encoder.ids((b" " + w).decode())]


def plain_probability(w, shares, counts, s, t, own):
    """The probability of s[t] (s: two ends, subwords, an end) slot by slot; own: occurrences to leave out of the counts."""
    singles, pairs, triples, total = counts
    end, first = len(singles) - 1, 2
    window = first + (t - first) // lm.STRIDE * lm.STRIDE
    logits, values = [], []
    for j in range(max(first, window - lm.CONTEXT), t):
        z = float(w["q"][shares.classes[s[t - 1]]] @ w["k"][shares.classes[s[j - 1]]]) + w["near"][t - j]
        if s[j - 1] == s[t - 1]:
            z += w["same"][0] + (w["same"][1] if s[j - 2] == s[t - 2] else 0)
        logits.append(z)
        values.append(float(s[j] == s[t]))
    one = singles[s[t - 1]] - own
    two = (pairs[s[t - 2], s[t - 1]] if t > first else singles[end]) - own
    step = lambda c: min(lm.STEPS - 1, 1 + int(math.log2(c))) if c > 0 else 0
    memory = w["memory"][step(two) * lm.STEPS + step(one)]
    logits.append(memory[0])
    values.append((singles[s[t]] - own + 0.1) / (total - own + 0.1 * len(singles)))
    if one > 0:
        logits.append(memory[1])
        values.append((pairs[s[t - 1], s[t]] - own) / one)
    if two > 0:
        logits.append(memory[2])
        values.append((triples[s[t - 2], s[t - 1], s[t]] - own) / two)
    a = np.exp(np.array(logits, float) - max(logits))
    return float(a @ np.array(values) / a.sum())


def counted(lines, size):
    singles, pairs, triples = np.zeros(size + 1, np.int64), Counter(), Counter()
    for s in lines:
        for t in range(2, len(s)):
            singles[s[t]] += 1
            pairs[s[t - 1], s[t]] += 1
            triples[s[t - 2], s[t - 1], s[t]] += 1
    return singles, pairs, triples, int(singles.sum())


@pytest.fixture(scope="module")
def scored(spark):
    """The rows' results and the weights that gave them, from blocks of 400 subwords and small parts."""
    held, train = [], lm.train
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "PART_GRAMS", 500)
        patch.setattr(lm, "train", lambda *a, **k: held.append(train(*a, **k)) or held[-1])
        df = spark.createDataFrame([(a, b, 1) for a, b in ROWS], "doc_id long, text string, block int").repartition(3)
        return lm.score_texts(df, tokenizer_path(), block=400).collect(), held[0]


def test_base_scores_equal_brute_force(scored):
    counts = Counter(w for i, t in ROWS if in_training(i) for w in [*lower(t), "end"])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in ROWS:
        words = [*lower(t), "end"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        expected.append((i, not in_training(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    assert sorted(expected, key=str) == sorted(((*r[:5], round(r[5], 6)) for r in scored[0]), key=str)


def test_scores_equal_brute_force_from_the_texts_on(scored):
    found, w = scored
    encoder, vocabulary = Encoder(tokenizer_path()), lm.Vocabulary(tokenizer_path())
    end = vocabulary.size
    line = lambda t: [end, end, *text_ids(encoder, t), end]
    counts = counted([line(t) for i, t in ROWS if in_training(i)], end)
    shares = lm.Shares(vocabulary, counts[0])
    expected = []
    for i, t in ROWS:
        s = line(t)
        expected.append((i, len(lower(t)) + 1, sum(math.log10(plain_probability(w, shares, counts, s, at, 0)) for at in range(2, len(s)))))
    key = lambda r: (str(r[0]), r[1], round(r[2], 2))
    for one, two in zip(sorted(expected, key=key), sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in found), key=key), strict=True):
        assert one[:2] == two[:2] and abs(one[2] - two[2]) < 1e-3 * max(1, abs(one[2])), (one, two)


class Small:
    """A vocabulary of nine ids, of which 0 to 4 begin words."""

    size, starts = 9, np.array([True] * 5 + [False] * 4 + [True])


def placed(texts, train=None):
    lines = [[9, 9, *t, 9] for t in texts]
    counts = counted(lines, 9)
    blob = lm.packed(np.array([x for t in texts for x in t], np.int64))
    block = lm.Block([len(t) for t in texts], blob, Small)
    grams, at, owners = block.grams()
    return lm.Placed(block, *np.split(np.bincount(at, minlength=len(grams))[at][: 2 * len(block.places)], 2), lm.Shares(Small, counts[0]), train), lines, counts


def some_weights(seed):
    rng = np.random.default_rng(seed)
    return {k: v + 0.3 * rng.standard_normal(v.shape) for k, v in lm.initial().items()}


def test_windows_score_each_token_once_causally_and_leave_own_counts_out():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 9, n).tolist() for n in (0, 1, 31, 32, 33, 200)]
    train, w = np.array([True, False, True, False, True, True]), some_weights(2)
    p, lines, counts = placed(texts, train)
    shares, seen = lm.Shares(Small, counts[0]), [[] for _ in texts]
    for at in range(0, len(p.window_at), 3):
        x = p.batch(slice(at, at + 3))
        for text, real, row in zip(p.window_text[at : at + 3], x["real"], lm.probabilities(w, x), strict=True):
            seen[text] += row[real].tolist()
    for text, s in enumerate(lines):
        expected = [plain_probability(w, shares, counts, s, t, int(train[text])) for t in range(2, len(s))]
        assert np.allclose(expected, seen[text], rtol=1e-4), text


def test_probabilities_of_all_subwords_and_the_end_add_up_to_one():
    texts, w = [[0, 1, 2, 0, 1], [3, 3, 3], [], [0, 5, 6] * 20], some_weights(3)
    _, lines, counts = placed(texts)
    shares = lm.Shares(Small, counts[0])
    for s, t in ((lines[0], 6), (lines[0], 2), (lines[1], 4), (lines[3], 50)):
        assert abs(sum(plain_probability(w, shares, counts, [*s[:t], x], t, 0) for x in range(10)) - 1) < 1e-6


def test_gradients_and_learning():
    rng = np.random.default_rng(2)
    p, _, _ = placed([np.tile(rng.integers(0, 9, 7), 40).tolist(), rng.integers(0, 9, 100).tolist()], np.array([True, True]))
    w, x = some_weights(4), p.batch(slice(0, 9))
    loss = lambda w: -(np.log(lm.probabilities(w, x)) * x["real"]).sum() / x["real"].sum()
    g = lm.gradients(w, x)
    row, one, two = int(x["row"][3, 4]), int(x["query_class"][2, 3]), int(x["key_class"][4, 12])
    for name, at in (("q", (one, 1)), ("k", (two, 2)), ("near", (4,)), ("same", (0,)), ("same", (1,)), ("memory", (row, 1)), ("memory", (row, 2))):
        kept = w[name][at]
        w[name][at] = kept + 1e-4
        up = loss(w)
        w[name][at] = kept - 1e-4
        down = loss(w)
        w[name][at] = kept
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-5, name
    trainer = lm.Trainer(lm.initial(), 0.02)
    before = loss(trainer.w)
    for _ in range(60):
        trainer.step(x)
    assert loss(trainer.w) < before - 0.1


def test_a_round_trains_on_all_windows_of_training_texts(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    seen = []
    run = lm._train
    monkeypatch.setattr(lm, "_train", lambda *a: seen.append(a) or run(*a))
    rows = df.selectExpr("doc_id", "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0 or doc_id is null held_out", "text")
    blocks, shares = lm.blocks_of(rows, tokenizer_path(), 300)
    lm.train(blocks, shares, rounds=2)
    encoder = Encoder(tokenizer_path())
    assert len(seen) == 2
    for arguments in seen:
        each = blocks.select("held_out", "sizes", "ids").coalesce(1).mapInArrow(run(*arguments), "at int, x double, n double")
        assert each.first()["n"] == sum(len(text_ids(encoder, t)) + 1 for i, t in ROWS if in_training(i))


def test_scores_dont_hang_on_blocks_and_parts(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"])
    monkeypatch.setattr(lm, "train", lambda *a, **k: lm.initial())
    score = lambda **k: [r["score"] for r in sorted(lm.score_texts(df, tokenizer_path(), **k).collect(), key=key)]
    whole = score()
    monkeypatch.setattr(lm, "PART_GRAMS", 500)
    assert np.allclose(whole, score(block=100), rtol=1e-5)


def test_training_helps_on_held_out_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 11}" for j in range(1 + 7 * (i % 40)))) for i in range(160)], "doc_id long, text string")
    trained = lm.score_texts(df, tokenizer_path()).where("held_out").agg({"score": "sum"}).first()[0]
    monkeypatch.setattr(lm, "train", lambda *a, **k: lm.initial())
    assert trained > lm.score_texts(df, tokenizer_path()).where("held_out").agg({"score": "sum"}).first()[0]


def test_empty_table_and_no_training_texts(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
    found = lm.score_texts(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), tokenizer_path()).collect()
    assert [(r["held_out"], r["n_known"], r["train_tokens"]) for r in found] == [(True, 0, 0)] * 2
    assert all(math.isfinite(r["score"]) for r in found)


def test_a_block_counts_what_it_has_itself():
    texts = [[0, 1, 2, 0, 1], [3, 3, 3], [], [0, 1, 6] * 5]
    block = lm.Block([len(t) for t in texts], lm.packed(np.array([x for t in texts for x in t], np.int64)), Small)
    lines = [[9, 9, *t, 9] for t in texts]
    _, pairs, triples, _ = counted(lines, 9)
    one, two = block.own_counts()
    assert one.tolist() == [pairs[s[t - 1], s[t]] for s in lines for t in range(2, len(s))]
    assert two.tolist() == [triples[s[t - 2], s[t - 1], s[t]] for s in lines for t in range(2, len(s))]
    some = block.alone(np.array([True, False, True, True]))
    assert some.sizes.tolist() == [5, 0, 15] and some.line.tolist() == [*lines[0], *lines[2], *lines[3]]


def test_parts_return_what_the_other_blocks_have():
    lines = [[[0, 1, 2, 0, 1], [3, 3, 3]], [[0, 1, 6] * 5, []]]
    blocks = [lm.Block([len(t) for t in texts], lm.packed(np.array([x for t in texts for x in t], np.int64)), Small) for texts in lines]
    bits, asked, own = lm.number_bits(Small.size + 1), [], []
    for number, block in enumerate(blocks):
        grams, at, owners = block.grams()
        own.append((grams, block.trained(at, owners, len(grams), [False, False])))
        few = int(np.searchsorted(grams, lm.WORDS))
        steps = [lm.packed(np.diff(x, prepend=0)) for x in (grams[:few], grams[few:] - lm.WORDS)]
        asked.append({"part": 0, "block": number, "grams": b"".join(len(y).to_bytes(4, "little") + y for y in steps), "counts": lm.packed(own[-1][1])})
    found = lm._add_counts(1, bits)((pa.scalar(0),), pa.Table.from_pylist(asked, lm._ASKED)).to_pylist()
    for k, (grams, _) in enumerate(own):
        other = dict(zip(*(x.tolist() for x in own[1 - k]), strict=True))
        expected = [other.get(g, 0) for g in grams.tolist()]
        assert lm.found_counts(blocks[k], grams, [found[k]], 1).tolist() == expected and any(expected) and not all(expected)


def test_ids_that_come_again_are_packed_small():
    rng = np.random.default_rng(3)
    for x in (np.tile(rng.integers(0, 50_000, 5000), 4), rng.integers(0, 2**40, 100), np.empty(0, np.int64), np.zeros(3, np.int64)):
        for whole in (False, True):
            assert lm.unpacked(lm.packed(x, whole)).tolist() == x.tolist()
    assert len(lm.packed(np.tile(rng.integers(0, 50_000, 5000), 4), True)) < 12_000
