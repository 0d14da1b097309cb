"""Two tokenizers' tokens of one text aligned by bytes, and how many documents link each pair of ids.

Per document, byte offsets where both tokenizers end a token part the tokens into
groups; each stretch between two ends, whichever tokenizer has them, is one link: a token
of each side that overlap there. A link's count is the number of documents that
hold its pair of ids.

Pairs are counted outside of memory. A task collects the distinct pairs of its
documents; when a block is full, it is sorted, each pair with its number of
documents, parted by radix of the first id, and every part is a run: frames of
zstd, each with its last key. The block's documents stay in a file of the shared
folder: their pairs by place in the block's runs. The runs of a radix are merged by
a heap of the frames' last keys, which says how far all runs are known. Keys are in order of the
first id, so when an id is passed all its pairs are counted, and the highest count
is known; counts go back to the runs they came from, place by place. So
does a block have its pairs' counts, and reads its documents once more to sum them up. A
merge takes ``fan`` runs on average; more are merged in levels, and counts go down the levels again.
What is shuffled are runs: a pair that all documents hold is one record of a block.

Defined results: a text that is null, empty, or not what either tokenizer's
tokens spell has no tokens and zeros; null and repeated ids, and repeated rows,
give a row each, and each row counts; a long text is aligned in parts that end where
neither tokenizer joins anything; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, record, slices, written
from .token_files import place
from .tokens import _byte_letters, load, load_fast

RADIXES, BLOCK_RECORDS, FRAME_RECORDS, FAN, SEGMENT = 64, 1 << 21, 1 << 13, 512, 1 << 18
#: A blank between two printable ASCII characters: both tokenizers begin a token with it.
CUT = re.compile(r"[!-~](?= [!-~])")
_RUNS = pa.schema([("block", pa.int64()), ("radix", pa.int32()), ("file", pa.string()), ("lasts", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))])
_RUNS_DDL = "block long, radix int, file string, lasts array<long>, frames array<binary>"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, byte by byte in planes, in zstd."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or int(values.max()) <= np.iinfo(k).max)
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), kind(0).itemsize).T
    return bytes([planes.shape[0]]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    planes = planes.reshape(data[0], len(planes) // data[0])
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").reshape(-1).astype(np.int64)


class Pair:
    """Both tokenizers: ids of a text that begins with a blank, and the bytes of each id."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        self.fast = load_fast(first)
        self.library = None if self.fast else load(first)
        letters, vocab = _byte_letters(), load(first).get_vocab()
        # Special strings aren't spelled in byte letters; none is ever given.
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, n in vocab.items():
            self.a_bytes[n] = bytes(letters.get(c, 32) for c in token)
        self.model = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.said = [f"{i}{end}" for table, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(table)) for end in ends]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by each tokenizer of " " + text, or none where their bytes don't spell it."""
        found = []
        for text, b in zip(texts, self.model.encode(texts, num_threads=1), strict=True):
            full = " " + text
            if self.fast:
                a = self.fast.encode_to_numpy(full, disallowed_special=()).astype(np.int64)
            else:
                self.library.encode_special_tokens = True
                a = np.array(self.library.encode(full, add_special_tokens=False).ids, np.int64)
            data = full.encode()
            spelled = b"".join([self.a_bytes[i] for i in a.tolist()]) == data and b"".join([self.b_bytes[i] for i in b]) == data
            found.append((a, np.array(b, np.int64)) if spelled and text else (np.empty(0, np.int64),) * 2)
        return found


_pairs: dict[tuple[str, str], Pair] = {}


def pair(first: str, second: str) -> Pair:
    if (first, second) not in _pairs:
        _pairs[first, second] = Pair(first, second)
    return _pairs[first, second]


def aligned(both: Pair, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups of each text, its groups as a string, and all links: number of the text, id and id."""
    found = both.ids(texts)
    a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    n_a, n_b = (np.array([len(x[k]) for x in found]) for k in (0, 1))
    # Texts one after another: each ends at the same byte for both.
    a_end, b_end = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    a_of, b_of = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    shared = np.intersect1d(a_end, b_end, assume_unique=True)
    ends = np.union1d(a_end, b_end)
    at_a, at_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
    a_last, b_last = (shared[g] == e if len(shared) else np.empty(0, bool) for g, e in ((a_group, a_end), (b_group, b_end)))
    n_groups = np.bincount(a_of[a_last], minlength=len(texts))
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    codes = np.concatenate([2 * a + a_last, 2 * (len(both.a_bytes) + b) + b_last])[order].tolist()
    words = [both.said[c] for c in codes]
    stops = np.cumsum(n_a + n_b).tolist()
    groups = ["".join(words[start:stop])[:-1] for start, stop in zip([0, *stops[:-1]], stops, strict=True)]
    return n_a, n_b, n_groups, groups, a_of[at_a], a[at_a], b[at_b]


class Keys:
    """Pairs of ids as numbers in order of the first id's radix, the first id and the second."""

    def __init__(self, both: Pair, radixes: int):
        self.radixes, self.step, self.width = radixes, -(-len(both.a_bytes) // radixes), len(both.b_bytes)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a % self.radixes * self.step + a // self.radixes) * self.width + b

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each radix begins in sorted keys, and their end."""
        return np.searchsorted(keys, np.arange(self.radixes + 1) * (self.step * self.width))


def parts(text: str, cuts: bool, size: int) -> Iterator[str]:
    """The text less a blank at each cut, where both tokenizers part it."""
    at = 0
    while cuts and len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end() + 1
    yield text[at:]


Counted = tuple[list[tuple], np.ndarray, np.ndarray]


def _short(both: Pair, keys: Keys, texts: list[str]) -> Counted:
    """n_a, n_b, n_groups, n_links, hash and number of pairs of each text; all pairs, text by text in order, and their links."""
    n_a, n_b, n_groups, groups, of, a, b = aligned(both, texts)
    # Keys stay below 2**40, as both vocabularies do below a million.
    found, links = np.unique(of << 40 | keys.of(a, b), return_counts=True)
    rows = zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), np.bincount(of, minlength=len(texts)).tolist(), (hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups), np.bincount(found >> 40, minlength=len(texts)).tolist(), strict=True)
    return list(rows), found & (1 << 40) - 1, links


def _long(both: Pair, keys: Keys, text: str, size: int) -> Counted:
    """The same of one text, part by part."""
    sums, digest, held, links = np.zeros(4, np.int64), hashlib.sha256(), np.empty(0, np.int64), np.empty(0, np.int64)
    for number, part in enumerate(parts(text, both.cuts, size)):
        n_a, n_b, n_groups, groups, of, a, b = aligned(both, [part])
        if not n_a[0]:  # a part that isn't spelled: nor is the text
            return [(0, 0, 0, 0, "", 0)], np.empty(0, np.int64), np.empty(0, np.int64)
        sums += [n_a[0], n_b[0], n_groups[0], len(of)]
        digest.update((";" * (number > 0) + groups[0]).encode())
        own, n = np.unique(keys.of(a, b), return_counts=True)
        held, back = np.unique(np.concatenate([held, own]), return_inverse=True)
        links = np.bincount(back, np.concatenate([links, n]), len(held)).astype(np.int64)
    return [(*sums.tolist(), digest.hexdigest(), len(held))], held, links


def run_of(keys: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Sorted keys and their counts as frames, and the last key of each."""
    lasts, frames = [], []
    for at in range(0, len(keys), FRAME_RECORDS):
        own = keys[at : at + FRAME_RECORDS]
        gaps = pack(np.diff(own, prepend=0))
        lasts.append(int(own[-1]))
        frames.append(len(gaps).to_bytes(4, "little") + gaps + pack(counts[at : at + FRAME_RECORDS]))
    return lasts, frames


def merged(runs: list[tuple[list[int], list[bytes]]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Keys in order with their summed counts, all of a first id at once, and for each run that has some the places of its keys among them."""
    keys, counts, used = [np.empty(0, np.int64)] * len(runs), [np.empty(0, np.int64)] * len(runs), [0] * len(runs)
    known: list[tuple[int, int]] = []  # heap of the runs that have more frames, by the last key at hand

    def load(r: int) -> None:
        lasts, frames = runs[r]
        frame, k = frames[used[r]], used[r]
        cut = 4 + int.from_bytes(frame[:4], "little")
        keys[r], counts[r] = np.concatenate([keys[r], np.cumsum(unpack(frame[4:cut]))]), np.concatenate([counts[r], unpack(frame[cut:])])
        used[r] += 1
        if used[r] < len(frames):
            heappush(known, (lasts[k], r))

    for r in range(len(runs)):
        if runs[r][1]:
            load(r)
    heapify(known)
    firsts = np.array([k[0] if len(k) else -1 for k in keys])
    while True:
        # Of the first id that the least known run stands at, more may come; what lies before is known of all.
        bound = known[0][0] // width * width if known else np.iinfo(np.int64).max
        ready = np.flatnonzero((firsts >= 0) & (firsts < bound)).tolist()
        if ready:
            taken = [int(np.searchsorted(keys[r], bound)) for r in ready]
            found, back = np.unique(np.concatenate([keys[r][:n] for r, n in zip(ready, taken, strict=True)]), return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, back, np.concatenate([counts[r][:n] for r, n in zip(ready, taken, strict=True)]))
            yield found, sums, list(zip(ready, np.split(back, np.cumsum(taken)[:-1]), strict=True))
            for r, n in zip(ready, taken, strict=True):
                keys[r], counts[r] = keys[r][n:], counts[r][n:]
                firsts[r] = keys[r][0] if len(keys[r]) else -1
        if not known:
            return
        r = heappop(known)[1]
        load(r)
        firsts[r] = keys[r][0]


def answers(runs: list[tuple[list[int], list[bytes]]], width: int, above: np.ndarray | None = None) -> list[bytes]:
    """For each run, its keys' counts among all runs, doubled, and one more for the highest count of a first id; above has them for all keys where this isn't the last level."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in runs]
    at = 0
    for keys, sums, places in merged(runs, width):
        if above is None:
            starts = np.flatnonzero(np.diff(keys // width, prepend=-1))
            most = np.repeat(np.maximum.reduceat(sums, starts), np.diff(np.append(starts, len(keys))))
            value = sums << 1 | (sums == most)
        else:
            value, at = above[at : at + len(keys)], at + len(keys)
        for r, back in places:
            out[r].append(value[back])
    return [pack(np.concatenate(x)) for x in out]


class _Block:
    """Collects documents and their pairs until they are enough for a block."""

    def __init__(self, folder: str, kind: pa.DataType, keys: Keys):
        self.folder, self.keys, self.number = folder, keys, TaskContext.get().partitionId() << 24
        self.schema = pa.schema([("doc_id", kind), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())])
        self.rows, self.pairs, self.links, self.n = [], [], [], 0

    def add(self, ids: list, found: Counted) -> None:
        rows, pairs, links = found
        self.rows += [(i, *r) for i, r in zip(ids, rows, strict=True)]
        self.pairs.append(pairs)
        self.links.append(links)
        self.n += len(pairs)

    def flush(self) -> Iterator[list]:
        """The manifest's rows of the block's runs; a run of radix 0 is always there."""
        keys, codes, counts = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        docs = record(self.schema, *zip(*self.rows, strict=True))
        # Codes ascend within a document: gaps are smaller.
        n = docs.column("n_pairs").to_numpy()
        gaps, starts = np.diff(codes, prepend=0), (np.cumsum(n) - n)[n > 0]
        gaps[starts] = codes[starts]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as stream:
            stream.write_batch(docs)
        name = f"{self.folder}/{self.number}-{uuid.uuid4().hex}.block"
        system, path = place(name)
        with system.open_output_stream(path, compression=None) as f:
            for part in (sink.getvalue().to_pybytes(), pack(gaps), pack(np.concatenate(self.links))):
                f.write(len(part).to_bytes(8, "little") + part)
        bounds = self.keys.bounds(keys)
        for radix in range(self.keys.radixes):
            own = slice(bounds[radix], bounds[radix + 1])
            if radix == 0 or own.start < own.stop:
                yield [self.number, radix, name, *run_of(keys[own], counts[own])]
        self.number, self.rows, self.pairs, self.links, self.n = self.number + 1, [], [], [], 0


def summed(name: str, values: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """A block's documents, and of each the links of a highest count and the sum of all links' counts, given its runs' answers one after another."""
    system, path = place(name)
    with system.open_input_file(path) as f:
        docs, gaps, links = (f.read(int.from_bytes(f.read(8), "little")) for _ in range(3))
    docs, gaps, links = pa.ipc.open_stream(docs).read_next_batch(), unpack(gaps), unpack(links)
    n = docs.column("n_pairs").to_numpy()
    codes = np.cumsum(gaps)
    stops = np.cumsum(n)
    before = np.concatenate([np.zeros(1, np.int64), codes])[stops - n]
    found = values[codes - np.repeat(before, n)]
    total = lambda x: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])[np.concatenate([[0], stops])])
    return docs, total(links * (found & 1)), total(links * (found >> 1))


def _write_blocks(folder: str, first: str, second: str, radixes: int, block_records: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(first, second)
        keys, block = Keys(both, radixes), None
        for b in slices(batches, 1, 1_000_000):
            block = block or _Block(folder, b.schema.field(0).type, keys)
            ids, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= segment]
            if short:
                block.add([ids[i] for i in short], _short(both, keys, [texts[i] for i in short]))
            for i in sorted(set(range(len(texts))) - set(short)):
                block.add([ids[i]], _long(both, keys, texts[i], segment))
            if block.n >= block_records:
                yield from (record(_RUNS, *([x] for x in row)) for row in block.flush())
        if block and block.rows:
            yield from (record(_RUNS, *([x] for x in row)) for row in block.flush())

    return run


def _runs(table: pa.Table) -> list[tuple[list[int], list[bytes]]]:
    return list(zip(table.column("lasts").to_pylist(), table.column("frames").to_pylist(), strict=True))


def _answered(table: pa.Table, found: list[bytes]) -> pa.Table:
    return table.select(["block", "radix", "file"]).append_column("answers", pa.array(found, pa.binary()))


def align_tokens(
    df: DataFrame, first: str, second: str, *, text: str = "text", radixes: int = RADIXES, block_records: int = BLOCK_RECORDS, fan: int = FAN, segment: int = SEGMENT
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of df (doc_id, text).

    first is a byte-level file of tokenizers, second one of sentencepiece.
    """
    folder = new_folder(df.sparkSession)
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    rows = df.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("_text"))
    kind, width = rows.schema["doc_id"].dataType.simpleString(), len(pair(first, second).b_bytes)
    levels = [(written(rows.mapInArrow(_write_blocks(folder, first, second, radixes, block_records, segment), _RUNS_DDL)), 1)]
    left = levels[0][0].where("radix = 0").count()

    def up(key: tuple, table: pa.Table) -> pa.Table:
        found = [(keys, sums) for keys, sums, _ in merged(_runs(table), width)]
        lasts, frames = run_of(*(np.concatenate([x[k] for x in found]) for k in (0, 1))) if found else ([], [])
        return pa.table([[key[1].as_py()], [key[0].as_py()], [None], [lasts], [frames]], schema=_RUNS)

    while left > fan:
        left = -(-left // fan)
        runs = levels[-1][0].withColumn("parent", F.expr(f"pmod(xxhash64(block), {left})"))
        levels[-1] = (runs, left)
        levels.append((written(runs.groupBy("radix", "parent").applyInArrow(up, _RUNS_DDL)), 1))

    answer_ddl = "block long, radix int, file string, answers binary"
    found = levels.pop()[0].groupBy("radix").applyInArrow(lambda t: _answered(t, answers(_runs(t), width)), answer_ddl)
    while levels:
        down = lambda t, above: _answered(t, answers(_runs(t), width, unpack(above.column("answers")[0].as_py())))
        parents = found.select(F.col("block").alias("parent"), "radix", "answers")
        found = levels.pop()[0].groupBy("radix", "parent").cogroup(parents.groupBy("radix", "parent")).applyInArrow(down, answer_ddl)

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("radix")
        docs, best, sums = summed(table.column("file")[0].as_py(), np.concatenate([unpack(x) for x in table.column("answers").to_pylist()]))
        return pa.Table.from_batches([docs]).select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))

    return found.groupBy("block").applyInArrow(total, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
