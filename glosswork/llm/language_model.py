"""Language-model scoring: a causal self-attention model on subword ids.

The model scores a text's words (A-Z lower-cased), each as the tokenizer encodes
it after a blank, and an end. One head of masked attention spreads the next
subword's probability over *slots*: the places of the window that lie before it,
whose value is the subword that stands there, and three memory slots, whose
values are the training texts' shares of a subword, of a subword after the one
before, and after the two before. A place attends by the likeness (``q`` and
``k``, by class) of the subword before it to the one before the next, by distance
(``near``) and by whether one or two subwords before are equal (``same``); a memory
slot's logit (``memory``) goes by how often its context was seen. One softmax runs
over all slots, so whatever a slot gives passes through the attention, and the
probabilities of all subwords and the end add up to one. Nothing else is mixed in
and no weight is set by hand: all are trained, on training texts alone, which
leave their own occurrence out of each count.

Texts lie in blocks of about ``BLOCK`` subwords. A block asks for each pair,
triple and word that it holds, once, with its own count, and each n-gram's part
adds up the blocks' counts and returns the sums to each block that asked: one row
for a block and part, however frequent an n-gram is, and none is left out.
Windows of ``STRIDE`` subwords overlap by ``CONTEXT``: each token is scored once,
with at least so many before it (or all there are), windows of many texts in one
batch. A round trains on all windows of all training texts: each task trains on
its blocks from the same start, with the counts of pairs and triples that the
block itself has (how much a count tells depends on it, not on the corpus), and
the weights are averaged by tokens. Scores take the counts of all training texts.

``base_score`` takes the words' counts from the same exchange. Words are told
apart by 62 bits of hash (1e9 different words hold two of one hash with a chance
of 1 in 9).

Defined results: null and empty texts are an end alone; repeated rows give a
row each, of the same scores; a null id is held out; other columns are left out.
The tokenizer is of the byte-level kind, whose words begin with a blank; a text
that is longer than a block is a block by itself.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, encoded, record, slices, written
from .hashing import mix, rolled_prefix
from .tokens import Encoder

STRIDE, CONTEXT, WIDTH = 8, 16, 8
#: Classes of the attention: the most frequent subwords are classes of their own, the others share.
OWN, SHARED = 512, 512
CLASSES = OWN + SHARED
#: A context's count falls into one of so many steps of a power of two; memory slots.
STEPS, SLOTS = 16, 3
#: Subwords in a block of texts, but for a text that alone has more; n-grams of all blocks in a part, on average no more.
BLOCK, PART_GRAMS = 1_000_000, 4_000_000
#: Windows in a training step and in a scoring batch.
BATCH = 512
#: Words beyond all pairs and triples.
WORDS = 1 << 62
#: White space that isn't ASCII's: only there may a subword hold the end of one word and the start of the next.
_OTHER_SPACE = re.compile(r"[^\S\t\n\r\x0b\x0c ]")
_SHAPES = {"q": (CLASSES, WIDTH), "k": (CLASSES, WIDTH), "near": (STRIDE + CONTEXT,), "same": (2,), "memory": (STEPS * STEPS, SLOTS)}
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary())])
_BLOCKS_DDL = "block long, doc_ids array<long>, held_out array<boolean>, sizes array<long>, ids binary"
_ASKED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_FOUND = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("words", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.int64())])
_OFFSETS = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(STRIDE + CONTEXT)[None, :]
_CAUSAL = np.where(_OFFSETS > 0, np.float32(0), np.float32(-1e9))
_LOW = np.float32(-1e9)
_FAST, _CLOSE, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()


def packed(x: np.ndarray, whole: bool = False) -> bytes:
    """Numbers from 0, compressed, of as many bytes as the largest needs: in byte planes or (whole) one after another, for those whose sequences come again."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    data = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width | whole << 7]) + (_CLOSE if whole else _FAST).compress((data if whole else data.T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    width, data = blob[0] & 127, np.frombuffer(_OPEN.decompress(blob[1:]), np.uint8)
    numbers = data.reshape(-1, width) if blob[0] >> 7 else data.reshape(width, -1).T
    out = np.zeros((len(numbers), 8), np.uint8)
    out[:, :width] = numbers
    return out.view("<i8").ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and which of them is at each place."""
    codes, found = pd.factorize(keys)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], rank[codes]


class Vocabulary:
    """Number of ids, and which of them begin with a blank (and so a word)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.starts = np.zeros(self.size + 1, bool)
        self.starts[[i for token, i in ids.items() if token[0] == "Ġ"]] = True  # byte-level files write a blank so
        self.starts[self.size] = True


class WordIds:
    """The ids of a text's words, each as it is encoded after a blank."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        line = b"".join(b" " + w for w in words).decode()
        if _OTHER_SPACE.search(line):  # might join words into one subword
            return np.concatenate([self.encoder.ids((b" " + w).decode()) for w in words])
        return self.encoder.ids(line) if words else np.empty(0, np.uint32)


def _blocks(path: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = WordIds(path), TaskContext.get().partitionId() << 32
        doc_ids, held_out, sizes, ids, total = [], [], [], [], 0

        def full() -> pa.RecordBatch:
            return record(_BLOCKS, [number], [doc_ids], [held_out], [sizes], [packed(np.concatenate(ids), True)])

        for b in slices(batches, 2):
            for doc_id, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoded(b, 2), strict=True):
                own = words.of(text)
                n = len(own)
                if total and total + n + 1 > block:
                    yield full()
                    number += 1
                    doc_ids, held_out, sizes, ids, total = [], [], [], [], 0
                doc_ids.append(doc_id)
                held_out.append(held)
                sizes.append(n)
                ids.append(own)
                total += n + 1
        if doc_ids:
            yield full()

    return run


class Block:
    """The texts of a block in one line: two ends before each text and one after; places are the subwords and closing ends."""

    def __init__(self, sizes: list[int], ids: bytes, vocabulary: Vocabulary):
        self.sizes, end = np.array(sizes, np.int64), vocabulary.size
        flat = unpacked(ids)
        starts = np.cumsum(self.sizes + 3) - self.sizes - 3
        self.line = np.full(int((self.sizes + 3).sum()), end, np.int64)
        self.real = np.ones(len(self.line), bool)
        self.real[starts] = self.real[starts + 1] = False
        inside = self.real.copy()
        inside[starts + self.sizes + 2] = False
        self.line[inside] = flat
        self.inside, self.vocabulary = inside, vocabulary
        self.starts, self.base = starts, end + 1
        self.places = np.nonzero(self.real)[0]
        self.text = np.repeat(np.arange(len(sizes)), self.sizes + 1)
        self.first = vocabulary.starts[self.line] & self.real  # of a word, or an end

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """A key above ``WORDS`` for each word and closing end, and its text."""
        at = np.nonzero(self.first)[0]
        # A word runs to the next one's start; two ends stand before the next text.
        stop = np.append(at[1:], len(self.line))
        closing = self.line[at] == self.base - 1
        stop[closing] = at[closing] + 1
        keys = rolled_prefix(mix(self.line.astype(np.uint64) + np.uint64(1)), at, stop)
        return (keys >> np.uint64(2)).astype(np.int64) | WORDS, self.text[np.searchsorted(self.places, at)]

    def numbers(self) -> np.ndarray:
        """The number of the pair, then of the triple, that ends at each place; spread over their range by an odd factor, so that a range of them is a fair part."""
        s, p = self.line, self.places
        pairs = s[p - 1] * self.base + s[p]
        triples = (s[p - 2] * self.base + s[p - 1]) * self.base + s[p] + self.base * self.base
        with np.errstate(over="ignore"):
            numbers = (np.concatenate([pairs, triples]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << number_bits(self.base)) - 1)
        return numbers.astype(np.int64)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams ascending, which is at each place (pairs, then triples, then words), and the words' texts."""
        words, owners = self.words()
        return *distinct(np.concatenate([self.numbers(), words])), owners

    def trained(self, at: np.ndarray, owners: np.ndarray, n: int, held_out: list[bool]) -> np.ndarray:
        """How often the block's training texts have each of its n distinct n-grams."""
        train = ~np.array(held_out, bool)
        return np.bincount(at, np.concatenate([train[self.text], train[self.text], train[owners]]), n).astype(np.int64)

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the block itself has the pair and the triple that end at each place."""
        codes = pd.factorize(self.numbers())[0]
        return np.split(np.bincount(codes)[codes], 2)

    def alone(self, keep: np.ndarray) -> Block:
        """The block of some of its texts."""
        flat = self.line[self.inside]
        return Block(self.sizes[keep], packed(flat[np.repeat(keep, self.sizes)]), self.vocabulary)


def number_bits(base: int) -> int:
    """Bits of the number of any pair or triple of so many subwords."""
    return (base**3 + base**2).bit_length()


def part_cuts(grams: np.ndarray, parts: int, base: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each part is a range of the pairs and triples and one of the words: the parts that have any of these ascending n-grams, how many, and the places of each."""
    few = int(np.searchsorted(grams, WORDS))
    limits = [np.array([k * span // parts for k in range(1, parts)], np.int64) + at for at, span in ((0, 1 << number_bits(base)), (WORDS, WORDS))]
    low = np.split(np.arange(few), np.searchsorted(grams[:few], limits[0]))
    high = np.split(np.arange(few, len(grams)), np.searchsorted(grams[few:], limits[1]))
    places = [np.concatenate(x) for x in zip(low, high, strict=True)]
    sizes = np.array([len(x) for x in places])
    some = np.nonzero(sizes)[0]
    return some, sizes[some], [places[k] for k in some]


def _count_ids(size: int):
    """How often the training texts of blocks (held_out, sizes, ids) have each id, and the end as the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for b in batches:
            for held_out, sizes, ids in _rows(b):
                train = ~np.array(held_out, bool)
                flat = unpacked(ids)
                total[:size] += np.bincount(flat[np.repeat(train, sizes)], minlength=size)
                total[size] += int(train.sum())
        some = np.nonzero(total)[0]
        yield record(pa.schema([("at", pa.int64()), ("c", pa.int64())]), some, total[some])

    return run


def _ask_counts(vocabulary, parts: int):
    """For each block and part, the block's n-grams and how often its training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, held_out, sizes, ids in _rows(b):
                block = Block(sizes, ids, vocabulary.value)
                grams, at, owners = block.grams()
                counts = block.trained(at, owners, len(grams), held_out)
                some, _, places = part_cuts(grams, parts, block.base)
                # Differences, of the pairs and triples and of the words, each from their range's start.
                few = [int(np.searchsorted(grams[x], WORDS)) for x in places]
                starts = [(k * (1 << number_bits(block.base)) // parts, k * WORDS // parts) for k in some.tolist()]
                steps = [b"".join(len(y).to_bytes(4, "little") + y for y in (packed(np.diff(grams[x[:f]], prepend=a)), packed(np.diff(grams[x[f:]] - WORDS, prepend=b)))) for x, f, (a, b) in zip(places, few, starts, strict=True)]
                yield record(_ASKED, some, np.full(len(some), number), steps, [packed(counts[x]) for x in places])

    return run


def _asked_grams(blob: bytes, part: int, parts: int, bits: int) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    low, high = unpacked(blob[4 : 4 + n]), unpacked(blob[8 + n :])
    return np.concatenate([np.cumsum(low) + part * (1 << bits) // parts, np.cumsum(high) + (part * WORDS // parts + WORDS)])


def _add_counts(parts: int, bits: int):
    """What the other blocks together have of each n-gram of a part, for each block in the order in which it asked; and how many words the part's training texts have."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asked = [_asked_grams(x, key[0].as_py(), parts, bits) for x in rows["grams"].to_pylist()]
        counts = np.concatenate([unpacked(x) for x in rows["counts"].to_pylist()])
        grams, at = distinct(np.concatenate(asked))
        totals = np.bincount(at, counts, len(grams)).astype(np.int64)
        words = [int(((grams >= WORDS) & (totals > 0)).sum())] + [0] * (len(asked) - 1)
        found = [packed(x) for x in np.split(totals[at] - counts, np.cumsum([len(x) for x in asked])[:-1])]
        return pa.Table.from_batches([record(_FOUND, rows["part"].combine_chunks(), rows["block"].combine_chunks(), found, words)])

    return run


def found_counts(block: Block, grams: np.ndarray, found: list[dict], parts: int) -> np.ndarray:
    """The other blocks' counts of a block's distinct n-grams, from what each part returned."""
    some, _, places = part_cuts(grams, parts, block.base)
    blobs, counts = {x["part"]: x["counts"] for x in found}, np.empty(len(grams), np.int64)
    for part, at in zip(some.tolist(), places, strict=True):
        counts[at] = unpacked(blobs[part])
    return counts


class Shares:
    """What every task knows of the training texts: counts of ids (the end is the last), and the classes."""

    def __init__(self, vocabulary: Vocabulary, singles: np.ndarray):
        self.vocabulary, self.singles, self.total = vocabulary, singles, int(singles.sum())
        rank = np.empty(len(singles), np.int64)
        rank[np.argsort(-singles, kind="stable")] = np.arange(len(singles))
        self.classes = np.where(rank < OWN, rank, OWN + np.arange(len(singles)) % SHARED)
        self.contexts = singles

    def within(self, contexts: np.ndarray) -> Shares:
        """The same, where subwords are as frequent as contexts, before another, as given."""
        out = copy.copy(self)
        out.contexts = contexts
        return out


class Placed:
    """A block's places with the values of their memory slots, and its windows."""

    def __init__(self, block: Block, pairs: np.ndarray, triples: np.ndarray, shares: Shares, train: np.ndarray | None = None):
        """pairs, triples: the counts of those that end at each place; train: the texts that are among the counted ones."""
        self.block, s, p = block, block.line, block.places
        here, last = s[p], s[p - 1]
        # A text that was counted leaves its own occurrence out of each count.
        own = np.int64(0) if train is None else train[block.text].astype(np.int64)
        two = np.concatenate([[0], pairs[:-1]])
        first = np.cumsum(block.sizes + 1) - block.sizes - 1  # of each text, after two ends
        two[first] = shares.contexts[-1]
        one, two = shares.contexts[last] - own, two - own
        self.values = np.empty((len(p), SLOTS), np.float32)
        self.values[:, 0] = (shares.singles[here] - own + 0.1) / (shares.total - own + 0.1 * len(shares.singles))
        self.values[:, 1] = (pairs - own) / np.maximum(one, 1)
        self.values[:, 2] = (triples - own) / np.maximum(two, 1)
        self.open = np.ones((len(p), SLOTS), bool)
        self.open[:, 1], self.open[:, 2] = one > 0, two > 0
        self.values[~self.open] = 0
        step = lambda c: np.minimum(STEPS - 1, np.frexp(np.maximum(c, 0).astype(np.float32))[1])
        self.row = step(two) * STEPS + step(one)
        self.classes, self.short = shares.classes[s], s.astype(np.int32)
        # Windows of each text: their first places, and how many places they score.
        per_text = block.sizes + 1
        number = -(-per_text // STRIDE)
        text = np.repeat(np.arange(len(per_text)), number)
        k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        self.window_text = text
        self.window_at = block.starts[text] + 2 + k * STRIDE  # in the line
        self.window_from = np.cumsum(per_text)[text] - per_text[text] + k * STRIDE  # among the places
        self.window_size = np.minimum(STRIDE, per_text[text] - k * STRIDE)
        self.text_start = block.starts[text] + 2

    def batch(self, w: slice) -> dict[str, np.ndarray]:
        """Inputs of the attention for so many windows: (windows, STRIDE) targets and (windows, CONTEXT + STRIDE) keys."""
        s, last = self.short, len(self.block.line) - 1
        at, size = self.window_at[w, None], self.window_size[w, None]
        key_at = at - CONTEXT + np.arange(CONTEXT + STRIDE)
        key_ok = (key_at >= self.text_start[w, None]) & (key_at < at + size)
        key_at = np.clip(key_at, 2, last)
        target_at = np.minimum(at + np.arange(STRIDE), last)
        place = np.minimum(self.window_from[w, None] + np.arange(STRIDE), len(self.row) - 1)
        return {
            "real": np.arange(STRIDE) < size, "key_ok": key_ok, "key": s[key_at], "target": s[target_at],
            "key_class": self.classes[key_at - 1], "query_class": self.classes[target_at - 1],
            "key_before": s[key_at - 1], "before": s[target_at - 1], "key_before_two": s[key_at - 2], "before_two": s[target_at - 2],
            "values": self.values[place], "row": self.row[place], "open": self.open[place],
        }


def initial() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    out = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    for name in "qk":
        out[name] = (0.3 * rng.standard_normal(_SHAPES[name])).astype(np.float32)
    out["near"] -= 4
    out["same"] += 1
    two, one = np.divmod(np.arange(STEPS * STEPS), STEPS)
    out["memory"][:, 1] = 0.7 * one
    out["memory"][:, 2] = 0.7 * two + 1
    return out


def attend(w: dict[str, np.ndarray], x: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """What each target's attention gives to the window's places and to the memory slots before it adds up to one, its sum, the target's probability, and which places follow one and two equal subwords and hold the target (1 or 0)."""
    number = w["near"].dtype
    e = w["q"][x["query_class"]] @ w["k"][x["key_class"]].transpose(0, 2, 1)
    e += w["near"][np.maximum(_OFFSETS, 0)] + _CAUSAL.astype(number)
    e += np.where(x["key_ok"], number.type(0), number.type(_LOW))[:, None, :]
    same = x["key_before"][:, None, :] == x["before"][:, :, None]
    twice = (same & (x["key_before_two"][:, None, :] == x["before_two"][:, :, None])).astype(number)
    same = same.astype(number)
    e += w["same"][0] * same
    e += w["same"][1] * twice
    np.minimum(e, 60, out=e)
    np.exp(e, out=e)
    m = np.exp(np.minimum(np.where(x["open"], w["memory"][x["row"]], _LOW), 60))
    total = e.sum(2) + m.sum(2)
    hit = (x["key"][:, None, :] == x["target"][:, :, None]).astype(number)
    given = np.einsum("bij,bij->bi", e, hit) + np.einsum("bij,bij->bi", m, x["values"])
    return e, m, total, np.maximum(given / total, 1e-30), same, twice, hit


def probabilities(w: dict[str, np.ndarray], x: dict[str, np.ndarray]) -> np.ndarray:
    """The probability of each target (windows, STRIDE), whatever stands where there is none."""
    return attend(w, x)[3]


def gradients(w: dict[str, np.ndarray], x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean negative log probability of the targets."""
    d, m, total, p, same, twice, hit = attend(w, x)
    # By a slot's logit: its attention less its share of what was given.
    scale = (x["real"] / max(1, x["real"].sum()) / total).astype(d.dtype)[:, :, None]
    over = (1 / p).astype(d.dtype)[:, :, None]
    d *= scale
    hit *= over
    np.subtract(1, hit, out=hit)
    d *= hit
    dm = m * scale * (1 - x["values"] * over)
    grads = {"near": np.bincount(np.maximum(_OFFSETS, 0).ravel(), (d.sum(0) * (_OFFSETS > 0)).ravel(), STRIDE + CONTEXT), "same": np.array([np.vdot(d, same), np.vdot(d, twice)])}
    for name, at, g in (("q", x["query_class"], d @ w["k"][x["key_class"]]), ("k", x["key_class"], d.transpose(0, 2, 1) @ w["q"][x["query_class"]])):
        places = at.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        grads[name] = np.bincount(places.ravel(), g.ravel(), CLASSES * WIDTH).reshape(-1, WIDTH)
    places = x["row"].reshape(-1, 1) * SLOTS + np.arange(SLOTS)
    grads["memory"] = np.bincount(places.ravel(), dm.ravel(), STEPS * STEPS * SLOTS).reshape(-1, SLOTS)
    return grads


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.steps, self.tokens = {k: v.copy() for k, v in weights.items()}, rate, 0, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def step(self, x: dict[str, np.ndarray]) -> None:
        self.steps += 1
        self.tokens += int(x["real"].sum())
        for k, g in gradients(self.w, x).items():
            g = g.astype(self.w[k].dtype)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-8)


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _SHAPES])


def _unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in _SHAPES.values()])[:-1]
    return {k: x.reshape(s).astype(np.float32) for (k, s), x in zip(_SHAPES.items(), np.split(values, cuts), strict=True)}


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch of blocks, one at a time."""
    for i in range(b.num_rows):
        yield tuple(c[i].as_py() for c in b.columns)


def _train(shared, shares, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value, rate)
        for b in batches:
            for held_out, sizes, ids in _rows(b):
                train = ~np.array(held_out, bool)
                if not train.any():
                    continue
                block = Block(sizes, ids, shares.value.vocabulary).alone(train)
                own = block.own_counts()
                # Shares of single subwords are those of all texts; contexts are as frequent as the block has them.
                singles = np.bincount(block.line[block.places], minlength=block.base)
                placed = Placed(block, *own, shares.value.within(singles), np.ones(len(block.sizes), bool))
                order = np.random.default_rng(len(sizes)).permutation(len(placed.window_text))
                for at in range(0, len(order), BATCH):
                    trainer.step(placed.batch(order[at : at + BATCH]))
        if trainer.tokens:
            values = _flat(trainer.w)
            yield record(pa.schema([("at", pa.int32()), ("x", pa.float64()), ("n", pa.float64())]), np.arange(len(values)), values * float(trainer.tokens), np.full(len(values), float(trainer.tokens)))

    return run


def train(blocks: DataFrame, shares, *, rounds: int = 1, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Weights trained over all windows of the training texts in blocks, by rounds of averaging."""
    weights = initial()
    for _ in range(rounds):
        shared = blocks.sparkSession.sparkContext.broadcast(weights)
        trained = blocks.select("held_out", "sizes", "ids").mapInArrow(_train(shared, shares, rate), "at int, x double, n double")
        mean = trained.groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("at").toPandas()
        if len(mean):
            weights = _unflat(mean["x"].to_numpy())
    return weights


def _score(weights, shares, parts: int):
    """Of each text of a block its scores; the base score less what each token's denominator takes; and the words that the block's parts were told to count."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, doc_ids, held_out, sizes, ids = (left[c][0].as_py() for c in _BLOCKS.names)
        block = Block(sizes, ids, shares.value.vocabulary)
        grams, at, owners = block.grams()
        counts = found_counts(block, grams, right.select(["part", "counts"]).to_pylist(), parts)
        counts = (counts + block.trained(at, owners, len(grams), held_out))[at]
        pairs, triples, words = np.split(counts, [len(block.places), 2 * len(block.places)])
        placed, scores, w = Placed(block, pairs, triples, shares.value), np.zeros(len(sizes)), weights.value
        for k in range(0, len(placed.window_at), BATCH):
            part = slice(k, k + BATCH)
            x = placed.batch(part)
            logs = np.where(x["real"], np.log10(np.maximum(probabilities(w, x), 1e-30)), 0).sum(1, dtype=np.float64)
            scores += np.bincount(placed.window_text[part], logs, len(sizes))
        n = np.bincount(owners, minlength=len(sizes))
        known = np.bincount(owners, words > 0, len(sizes)).astype(np.int64)
        base = np.bincount(owners, np.log10(words + 0.1), len(sizes))
        told = np.zeros(len(sizes), np.int64)
        told[0] = sum(right["words"].to_pylist())
        return pa.Table.from_batches([record(_SCORED, pa.array(doc_ids, pa.int64()), held_out, n, known, base, scores, told)])

    return run


def blocks_of(rows: DataFrame, tokenizer: str, block: int = BLOCK) -> tuple[DataFrame, object]:
    """Blocks of rows (doc_id, held_out, text), and what tasks share of the training texts."""
    vocabulary = Vocabulary(tokenizer)
    blocks = written(rows.select("doc_id", "held_out", "text").mapInArrow(_blocks(tokenizer, block), _BLOCKS_DDL))
    found = blocks.select("held_out", "sizes", "ids").mapInArrow(_count_ids(vocabulary.size), "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toPandas()
    singles = np.zeros(vocabulary.size + 1, np.int64)
    singles[found["at"].to_numpy(np.int64)] = found["c"]
    return blocks, rows.sparkSession.sparkContext.broadcast(Shares(vocabulary, singles))


def score_texts(df: DataFrame, tokenizer: str, *, text: str = "text", folds: int = 10, held_out_fold: int = 0, block: int = BLOCK, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df (doc_id, text)."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == held_out_fold).alias("held_out"), F.col(text).alias("text"))
    blocks, shares = blocks_of(rows, tokenizer, block)
    weights = spark.sparkContext.broadcast(train(blocks, shares, rounds=rounds))
    vocabulary, singles = shares.value.vocabulary, shares.value.singles
    places = blocks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y) + F.size("sizes")), F.lit(0))).first()[0]
    # Each subword and each end of a text closes a pair and a triple.
    parts = max(1, -(-2 * places // PART_GRAMS))
    asked = blocks.select("block", "held_out", "sizes", "ids").mapInArrow(_ask_counts(spark.sparkContext.broadcast(vocabulary), parts), "part long, block long, grams binary, counts binary")
    summed = asked.groupBy("part").applyInArrow(_add_counts(parts, number_bits(vocabulary.size + 1)), "part long, block long, counts binary, words long")
    scored = written(blocks.groupBy("block").cogroup(summed.groupBy("block")).applyInArrow(_score(weights, shares, parts), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words long"))
    discard(blocks)
    total, different = int(singles[vocabulary.starts].sum()), scored.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    base = F.col("base") - F.col("n_tokens") * float(np.log10(total + 0.1 * (different + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
