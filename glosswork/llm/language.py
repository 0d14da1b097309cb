"""Language identification of mixed text by scripts and Viterbi labelling.

A bounded sample of labelled documents (``sample_docs``) gives, for each
language, counts of byte trigrams in ``BUCKETS`` buckets and of the scripts of
its words. A word's script, told from code-point ranges, leaves as candidates
the languages that use it; its trigrams give a log score for each of these. A
Viterbi pass over the words of a text, with a penalty for each switch, labels
spans. Where one language leads all others by the penalty, words that favour it
change nothing and are passed over at once; the path stays exact.

Defined results: null text and text without a letter is ``und`` with score 0,
as is every text where nothing could be learned; words without a letter follow
their neighbours; repeated rows give a row each; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, record, slices

BUCKETS, CACHE_WORDS, UNLIKELY = 1 << 15, 200_000, -60.0
#: First code points of ranges and their scripts (fixed values from the Unicode blocks).
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x10000, 0x20000)
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other", "han", "other", "other", "han")
NAMES = sorted(set(SCRIPTS))
_STARTS = np.array(SCRIPT_STARTS)
_CODES = np.array([NAMES.index(s) for s in SCRIPTS])
#: ASCII characters that are no letters part words.
_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ALPHA = re.compile(r"[^\W\d_]")
_STAT_DDL = "lang string, at int, n double"
_STATS = pa.schema([("lang", pa.string()), ("at", pa.int32()), ("n", pa.float64())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])
_SPANS_DDL = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def split_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


@lru_cache(1 << 16)
def _script(letter: str) -> int:
    """A character's script, -1 if it is no letter."""
    return int(_CODES[np.searchsorted(_STARTS, ord(letter), side="right") - 1]) if letter.isalpha() else -1


def script_of(word: str) -> int:
    """The script of a word's first letter beyond ASCII, or that of ASCII letters; -1 without a letter."""
    found = -1
    for c in word:
        code = _script(c)
        if code >= 0:
            found = code
            if c > "\x7f" or word.isascii():
                break
    return found


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word between blanks, joined, and where each word's begin."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    starts = np.cumsum(lengths + 2) - lengths - 2
    keep = np.ones(len(code), bool)
    for gap in (0, 1):  # windows over two words
        inner = starts[1:] - 2 + gap
        keep[inner] = False
    bucket = (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)
    return bucket[keep], np.cumsum(lengths) - lengths


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for b in slices(batches, 1):
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(split_words(text or ""))
        for lang, found in counts.items():
            g, s = grams.setdefault(lang, np.zeros(BUCKETS)), scripts.setdefault(lang, np.zeros(len(NAMES)))
            words, n = list(found), np.fromiter(found.values(), float, len(found))
            if not words:
                continue
            codes = np.array([script_of(w.decode()) for w in words])
            s += np.bincount(codes[codes >= 0], n[codes >= 0], len(NAMES))
            buckets, starts = _trigrams(words)
            g += np.bincount(buckets, np.repeat(n, np.diff([*starts, len(buckets)])), BUCKETS)
    for lang in grams:
        found = np.concatenate([grams[lang], scripts[lang]])
        some = np.nonzero(found)[0]
        # A language without a word is known all the same.
        some = some if len(some) else np.array([0])
        yield record(_STATS, [lang] * len(some), some, found[some])


class Model:
    """Log scores by trigram bucket and language, and the scripts of each language."""

    def __init__(self, stats: dict[str, tuple[np.ndarray, np.ndarray]], smooth: float = 0.5, script_share: float = 0.001):
        self.langs = sorted(stats)
        g = np.stack([stats[x][0] for x in self.langs]) + smooth
        self.log = np.ascontiguousarray(np.log(g / g.sum(1, keepdims=True)).T.astype(np.float32))
        s = np.stack([stats[x][1] for x in self.langs])
        allowed = (s >= script_share * np.maximum(1, s.sum(1, keepdims=True))) & (s > 0)
        allowed[:, ~allowed.any(0)] = True  # nobody's script narrows nothing
        self.allowed = allowed.T


class Labeller:
    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty, self.index = model, penalty, {}
        self.scores = np.empty((0, len(model.langs)), np.float32)
        self.best = np.empty(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        missing = list(words.difference(self.index))
        if not missing:
            return
        if len(self.index) + len(missing) > CACHE_WORDS:
            self.index, self.scores, self.best = {}, self.scores[:0], self.best[:0]
            missing = list(words)
        model = self.model
        buckets, starts = _trigrams(missing)
        scores = np.add.reduceat(model.log[buckets], starts, axis=0)
        codes = np.array([script_of(w.decode()) for w in missing])
        scores = np.where(model.allowed[codes], scores, scores + UNLIKELY)
        best = scores.argmax(1)
        scores = scores - scores.max(1, keepdims=True)
        scores[codes < 0], best[codes < 0] = 0, -1
        self.index.update(zip(missing, range(len(self.scores), len(self.scores) + len(missing)), strict=True))
        self.scores, self.best = np.concatenate([self.scores, scores.astype(np.float32)]), np.concatenate([self.best, best])

    def label(self, words: list[bytes]) -> np.ndarray:
        """The language number of each word."""
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        best = self.best[at]
        known = np.nonzero(best >= 0)[0]
        if not len(known):
            return np.zeros(len(words), np.int64)
        # Words without a letter go with the word before, those at the start with the first.
        best = best[known[np.maximum(0, np.searchsorted(known, np.arange(len(words)), side="right") - 1)]]
        return viterbi(self.scores[at], best, self.penalty)


def viterbi(scores: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """The best path over rows of scores (0 for the best language, less for others), each switch at a penalty.

    best: a language of score 0 for each row. After a row in which one language
    leads by the penalty, rows it is best in leave every lead as it is.
    """
    n, states = scores.shape
    labels = best.copy()
    if states == 1:
        return labels
    ends = np.append(np.nonzero(np.diff(best))[0] + 1, n)
    values, leader, settled, i, run, trail = [0.0] * states, int(best[0]), False, 0, 0, []
    while i < n:
        while ends[run] <= i:
            run += 1
        if settled and best[i] == leader:
            i = int(ends[run])
            continue
        # Rows up to the run's end, and no further than a settled lead.
        for row in scores[i : min(int(ends[run]), i + 256)].tolist():
            least = values[leader] - penalty
            trail.append((i, leader, [v > least for v in values]))
            values = [(v if v > least else least) + s for v, s in zip(values, row)]
            leader = max(range(states), key=values.__getitem__)
            i += 1
            settled = sorted(values)[-2] <= values[leader] - penalty
            if settled:
                break
    state = leader
    for i, leader, stays in reversed(trail):
        labels[i] = state
        if not stays[state]:
            state = leader
    return labels


def train(df: DataFrame, *, text: str = "text", lang: str = "lang", sample_docs: int = 20_000) -> Model | None:
    """A model from all labelled rows of df, or about sample_docs of a language that has more, chosen by a hash of their ids; None without any.

    A task counts the sampled texts that it reads, Spark adds the counts up, and
    the driver gets a row for each language and bucket.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")).alias("_h"))
    # A share of the 63 bits of a hash: never none of them, however many rows there are.
    limits = rows.groupBy("lang").agg((F.least(F.lit(1.0), sample_docs / F.count(F.lit(1))) * F.lit(2.0**63)).alias("_limit"))
    sample = rows.join(F.broadcast(limits), "lang").where(F.shiftrightunsigned("_h", 1).cast("double") <= F.col("_limit")).select("lang", "text")
    counts = sample.mapInArrow(_stats, _STAT_DDL).groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    stats: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name, own in counts.groupby("lang"):
        found = np.zeros(BUCKETS + len(NAMES))
        found[own["at"].to_numpy()] = own["n"].to_numpy()
        stats[name] = found[:BUCKETS], found[BUCKETS:]
    return Model(stats) if stats else None


def label_languages(df: DataFrame, model: Model | None, *, text: str = "text", penalty: float = 12.0, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its share of the letters' bytes), spans (of letter words) for each row of df."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), (crc_mod("doc_id", folds) == held_out_fold).alias("held_out"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty) if shared.value else None
        for b in slices(batches, 1):
            langs, scores, spans = [], [], []
            texts = [x or "" for x in b.column(1).to_pylist()]
            split = [split_words(x) for x in texts]
            if labeller:
                labeller.learn(set().union(*split))
            for raw, words in zip(texts, split, strict=True):
                if not (labeller and words and _ALPHA.search(raw)):
                    langs.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                found = labeller.label(words)
                weight = np.bincount(found, np.fromiter(map(len, words), float, len(words)), len(labeller.model.langs))
                cuts = [0, *(np.nonzero(np.diff(found))[0] + 1).tolist(), len(words)]
                langs.append(labeller.model.langs[int(weight.argmax())])
                scores.append(float(weight.max() / weight.sum()))
                spans.append([{"start": a, "end": e, "lang": labeller.model.langs[found[a]]} for a, e in zip(cuts, cuts[1:])])
            yield record(_SPANS, b.column(0), b.column(2), langs, scores, spans)

    return rows.mapInArrow(run, _SPANS_DDL)
