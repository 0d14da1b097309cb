"""Substring deduplication with a count-min prefilter.

A window is ``size`` consecutive words of one document; every word covered by a
window whose words also start anywhere else goes. Each window has an *anchor*,
the least hash among its runs of half its size: equal windows have equal
anchors at equal places, and neighbouring windows mostly share theirs, so
anchors are a tenth of the windows in number and their counts never fall below
the windows' own.

First pass: partitions sketch their anchors, the merged count-min sketch tells
which may occur twice. Second pass: only windows with such an anchor go on,
dealt by anchor and grouped by 128 bits of hash, so every repeated window is
found and none that is unique (1e13 windows hold two of equal hashes with a
chance of 1 in 1e12). Windows already
seen twice within a task's batch are settled there: one row tells of them, so a
passage that a third of all rows hold is a row a batch. The streams are sorted
by anchor and hash and compared to their neighbours; no group is ever held. A
stretch of windows that share an anchor thus comes out as one range, and a
task tells of a document once, however many of its windows it has seen.

Defined results: null, empty and short texts lose nothing; equal rows repeat
each other; rows are told apart by their id and text; null ids are rows like
any other; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, record, slices
from .hashing import WordHashes, mix, rolled, sliding
from .sketches import repeated, sketch

_SEGMENTS = pa.schema([("anchor", pa.int64()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("hashes", pa.list_(pa.int64())), ("more", pa.list_(pa.int64()))])
_SEGMENTS_DDL = "anchor long, kind byte, doc_id long, text_hash long, start int, count int, hashes array<long>, more array<long>"
_WINDOWS = pa.schema([("hash", pa.int64()), ("more", pa.int64()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])
_HITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_HITS_DDL = "doc_id long, text_hash long, starts array<int>, counts array<int>"
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
_KEPT_DDL = "doc_id long, n_words long, n_removed long, text string"
#: A window to be compared, one of a document settled in its batch, a settled window that others are to know of.
OPEN, SETTLED, KNOWN = 0, 1, 2
#: Hits that a reducer gathers before it joins them to ranges, and twice the ranges that it holds before it sends them on.
FLUSH_HITS = 200_000
#: Bytes of the texts whose windows are worked out together, and words whose hashes a task keeps.
SLICE, WORDS = 1_500_000, 100_000


class Windows:
    """The windows of a slice of texts: each one's hash, anchor, document and place."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, size: int):
        split = [t.split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        words = hashes.of([w for part in split for w in part])
        n, half = len(words), size // 2 + 1
        ends = np.repeat(np.cumsum(lengths), lengths)  # of the document that each word is in
        count = max(0, n - size + 1)
        self.valid = np.arange(count) + size <= ends[:count] if count else np.empty(0, bool)
        grams = rolled(words, half)
        span = size - half + 1
        self.anchor = sliding(grams, span, np.minimum)[:count]
        self.grams, self.span = grams, span
        self.hash = mix(rolled(words, size) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if count else np.empty(0, np.uint64)
        self.words, self.size, self.count = words, size, count
        self.doc = np.repeat(np.arange(len(split)), lengths)[:count]
        self.place = np.arange(count) - np.repeat(np.cumsum(lengths) - lengths, lengths)[:count]

    def more(self) -> np.ndarray:
        """64 further bits of each window's hash, from words whose hashes were mixed first."""
        return mix(rolled(mix(self.words ^ np.uint64(0x5851F42D4C957F2D)), self.size)) if self.count else self.hash

    def anchors(self) -> np.ndarray:
        """The anchor hashes, once for each place where one stands."""
        if not len(self.valid):
            return self.grams[:0]
        # A place is an anchor if it is the least of some window; others see a lesser one in all windows around.
        by_window = np.where(self.valid, self.anchor, np.uint64(0))
        edge = np.zeros(self.span - 1, np.uint64)
        best = sliding(np.concatenate([edge, by_window, edge]), self.span, np.maximum)
        return self.grams[best[: len(self.grams)] == self.grams[: len(best)]]


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return encoded(b, 2)


def _candidates(shared, size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(WORDS), shared.value
        for b in slices(batches, 2, SLICE):
            windows = Windows(_texts(b), hashes, size)
            at = np.nonzero(windows.valid)[0]
            at = at[repeated(bits, windows.anchor[at], width)] if len(at) else at
            if not len(at):
                continue
            # Segments: windows in a row of one document with one anchor.
            anchor, doc, place, own = windows.anchor[at], windows.doc[at], windows.place[at], windows.hash[at].view(np.int64)
            more = windows.more()[at].view(np.int64)
            new = np.concatenate([[True], (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
            cuts = np.append(np.nonzero(new)[0], len(at))
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            known: dict[bytes, list[int]] = {}
            for k, (a, e) in enumerate(zip(cuts, cuts[1:])):
                known.setdefault(own[a:e].tobytes() + more[a:e].tobytes(), []).append(k)
            out: list[list] = [[] for _ in range(8)]

            def put(*row):
                for column, x in zip(out, row, strict=True):
                    column.append(x)

            route = mix(at.astype(np.uint64) ^ anchor).view(np.int64)
            signed = anchor.view(np.int64)
            for found in known.values():
                for k in found:
                    a, e = cuts[k], cuts[k + 1]
                    i = doc[a]
                    if len(found) == 1:
                        put(signed[a], OPEN, ids[i], texts[i], place[a], 1, own[a:e], more[a:e])
                    else:
                        put(route[a], SETTLED, ids[i], texts[i], place[a], e - a, None, None)
                if len(found) > 1:
                    put(signed[a], KNOWN, None, None, 0, 0, own[a:e], more[a:e])
            yield record(_SEGMENTS, *out)

    return run


def _opened(segments: DataFrame) -> DataFrame:
    """A row for each window of a segment; settled segments stay as they are."""
    hashes = F.when(F.col("kind") == SETTLED, F.array(F.struct(F.col("anchor").alias("hashes"), F.lit(0).cast("long").alias("more")))).otherwise(F.arrays_zip("hashes", "more"))
    rows = segments.select("anchor", "kind", "doc_id", "text_hash", "start", "count", F.posexplode(hashes).alias("_at", "_w"))
    return rows.select("anchor", F.col("_w.hashes").alias("hash"), F.col("_w.more").alias("more"), "kind", "doc_id", "text_hash", (F.col("start") + F.col("_at")).cast("int").alias("start"), "count")


Ranges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _ranges(parts: list[Ranges]) -> Ranges:
    """Hits and ranges (no_id, doc, text, start, count) in order, those in a row of one document as one; settled ranges may lie over them."""
    no_id, doc, text, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, text, doc, no_id))
    no_id, doc, text, start, count = no_id[order], doc[order], text[order], start[order], count[order]
    new = _starts(no_id, doc, text)
    cuts = np.flatnonzero(new | np.concatenate([[True], start[1:] > start[:-1] + count[:-1]]))
    return no_id[cuts], doc[cuts], text[cuts], start[cuts], np.maximum.reduceat(start + count, cuts) - start[cuts]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row but the first differs from the one before in a key; true for the first."""
    return np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted so that equal ones are neighbours: those that have an equal one, as ranges by document."""
    held: list[Ranges] = []
    n_held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, n_held
        if held:
            no_id, doc, text, start, count = _ranges(held)
            first = np.flatnonzero(_starts(no_id, doc, text))
            offsets = pa.array(np.append(first, len(doc)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start, count)]
            yield record(_HITS, pa.array(doc[first], mask=no_id[first]), pa.array(text[first]), *lists)
        held, n_held = [], 0

    carry = None  # the last hash of the batch before, its rows that wait, and whether it is known
    for b in batches:
        if carry is not None:
            b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
        hashes, more, kinds = (b.column(i).to_numpy() for i in range(3))
        live = kinds != SETTLED
        # The last hash may go on in the next batch: two of its rows tell as much as all.
        tail = (hashes == hashes[-1]) & (more == more[-1])
        carry_rows = np.nonzero(tail & live)[0]
        at = np.nonzero(live)[0]
        h, m = hashes[at], more[at]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (m[1:] != m[:-1])]) if len(h) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=0) > 1 if len(group) else np.empty(0, bool)
        some = np.zeros(len(many), bool)
        np.logical_or.at(some, group, kinds[at] == KNOWN)
        hit = (many | some)[group] & (kinds[at] == OPEN) if len(group) else np.empty(0, bool)
        rows = np.concatenate([np.nonzero(~live)[0], at[hit]])
        # Settled rows are sent in the batch they come in; waiting rows stay until their hash is settled.
        carry = None
        if len(carry_rows):
            known = bool((many | some)[group[-1]])
            if known:
                keep = pa.array(carry_rows[:1])
                carry = b.take(keep).set_column(2, _WINDOWS.field(2), pa.array([KNOWN], pa.int8()))
            else:
                carry = b.take(pa.array(carry_rows))
        if len(rows):
            taken = b.take(pa.array(rows))
            ids = taken.column(3)
            held.append((ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), taken.column(4).to_numpy(), taken.column(5).to_numpy().astype(np.int64), taken.column(6).to_numpy().astype(np.int64)))
            n_held += len(rows)
            if n_held >= FLUSH_HITS:
                held = [_ranges(held)]
                n_held = len(held[0][0])
                if 2 * n_held >= FLUSH_HITS:
                    yield from flush()
    yield from flush()


def _removed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            counts, gone, texts = [], [], []
            for text, starts, lengths in zip(encoded(b, 1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = text.split()
                counts.append(len(words))
                if starts:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, np.add(starts, lengths) + size - 1, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                gone.append(counts[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield record(_KEPT, b.column(0), counts, gone, texts)

    return run


def remove_repeats(df: DataFrame, *, text: str = "text", size: int = 35, max_width: int = 1 << 29) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words kept, joined by blanks) for each row of df (doc_id, text).

    max_width bounds the sketch, and with it the broadcast (a quarter byte a
    counter): larger corpora keep exact results and compare more windows.
    """
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Some six bytes a word and an anchor for each quarter of a window: four counters an anchor.
    width = min(max_width, 1 << max(16, int(4 * n_bytes / 6 / max(1, size // 4)).bit_length()))

    def keys(b: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([Windows(_texts(s), _own(), size).anchors() for s in slices([b], 2, SLICE)] or [np.empty(0, np.uint64)])

    held: list[WordHashes] = []

    def _own() -> WordHashes:
        if not held:
            held.append(WordHashes(WORDS))
        return held[0]

    bits = spark.sparkContext.broadcast(sketch(rows, keys, rows=2, width=width))
    segments = rows.mapInArrow(_candidates(bits, size, width), _SEGMENTS_DDL).repartition("anchor")
    windows = _opened(segments).sortWithinPartitions("anchor", "hash", "more").drop("anchor")
    # A settled range counts its windows; an open one is a window.
    hits = windows.mapInArrow(_matched, _HITS_DDL).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("_starts"), F.flatten(F.collect_list("counts")).alias("_counts"))
    hits = hits.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_id"]) & (rows["text_hash"] == hits["_hash"]), "left")
    return joined.select("doc_id", "text", "_starts", "_counts").mapInArrow(_removed(size), _KEPT_DDL)
