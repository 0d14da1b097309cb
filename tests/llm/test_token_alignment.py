import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from glosswork.llm.token_alignment import align_tokens, answers, merged, pack, pair, parts, run_of, unpack

A, B = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = list("   \n\t\rabAB12.,'’\x85\x1c\x00éß漢😀́_-|\xa0") + ["<|endoftext|>", "'s", " \n", "word", " the", "<0x41>", "<s>", "▁"]


@pytest.fixture(scope="module")
def spelled():
    """(id, bytes) of a text's tokens by each tokenizer."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True

    def bytes_of(token: str) -> bytes:
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        return bytes(letters[c] for c in token)

    def run(text):
        a = [(i, bytes_of(first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, second.id_to_piece(i)) for i in second.encode(text)]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        data = (" " + text).encode()
        return (a, b) if text and b"".join(x for _, x in a) == data == b"".join(x for _, x in b) else ([], [])

    return run


def ranges(tokens):
    out, at = [], 0
    for token, data in tokens:
        out.append((token, at, at + len(data)))
        at += len(data)
    return out


def brute(spelled, rows):
    held, docs = Counter(), []
    for doc_id, text in rows:
        a, b = (ranges(x) for x in spelled(text or ""))
        links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        said, low = [], 0
        for end in ends:
            said.append("|".join(",".join(str(x) for x, s, e in side if low <= s and e <= end) for side in (a, b)))
            low = end
        held.update(set(links))
        docs.append((doc_id, len(a), len(b), len(ends), links, hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [(i, n_a, n_b, n, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), said) for i, n_a, n_b, n, links, said in docs]


def odd_rows(n, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return rows + [(None, "a null id"), (n, None), (n + 1, ""), (n + 2, " "), (n + 3, "  two"), (0, rows[0][1]), (0, rows[0][1])]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_brute_force(spark, spelled, small):
    rows = odd_rows(150, 7) + [(1000 + i, f"the words of a longer text, {i}, " * 6) for i in range(9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_a string").repartition(5)
    # Small blocks merge in three levels; short segments cut texts.
    out = align_tokens(df, A, B, **({"radixes": 3, "block_records": 60, "fan": 3, "segment": 20} if small else {})).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, brute(spelled, rows)))
    assert any(r.n_a == 0 for r in out) and any(r.n_best not in (0, r.n_links) for r in out)


def test_long_texts_are_cut_where_both_part(spark, spelled):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD[:-1]) for _ in range(400)) + " ".join(rng.choice(["some", "words.", "to", "cut", "é", "<s>", "x1"]) for _ in range(3000)) for _ in range(3)] + ["a▁b " * 500]
    assert all(len(list(parts(t, True, 100))) > 20 for t in texts[:3]) and all(" ".join(parts(t, True, 100)) == t for t in texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, cut = (sorted(map(tuple, align_tokens(df, A, B, segment=n).collect())) for n in (1 << 30, 100))
    assert whole == cut and whole[3][1:] == (0, 0, 0, 0, 0, 0, "")
    a, b = spelled(texts[0])
    assert whole[0][1:3] == (len(a), len(b))


def test_runs_merge_by_first_id(monkeypatch):
    import glosswork.llm.token_alignment as m

    monkeypatch.setattr(m, "FRAME_RECORDS", 4)
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 9):
        runs = [np.unique(rng.integers(0, 90, rng.integers(0, 40)), return_counts=True) for _ in range(k)]
        held = Counter()
        for keys, counts in runs:
            held.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        frames = [run_of(*r) for r in runs]
        steps = list(merged(frames, 10))
        assert [x for keys, _, _ in steps for x in keys.tolist()] == sorted(held) and [x for _, sums, _ in steps for x in sums.tolist()] == [held[x] for x in sorted(held)]
        firsts = [set((keys // 10).tolist()) for keys, _, _ in steps]
        assert all(not a & b for i, a in enumerate(firsts) for b in firsts[:i])
        most = {x // 10: max(n for y, n in held.items() if y // 10 == x // 10) for x in held}
        for (keys, _), found in zip(runs, answers(frames, 10), strict=True):
            assert unpack(found).tolist() == [2 * held[x] + (held[x] == most[x // 10]) for x in keys.tolist()]


def test_packed_numbers_and_no_rows(spark):
    for values in ([], [0], [255, 256], [1 << 40, 3], [70_000]):
        assert unpack(pack(np.array(values, np.int64))).tolist() == values
    assert pair(A, B).cuts
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    only_empty = align_tokens(spark.createDataFrame([("k", None)], "doc_id string, text string"), A, B).collect()
    assert [tuple(r) for r in only_empty] == [("k", 0, 0, 0, 0, 0, 0, "")]
