"""N-gram Jaccard self-join by rare-first prefix filtering.

A document's set is its distinct shingles of ``size`` words (a shorter text is
one shingle). Documents of equal sets form a *class* and are joined as one.
Shingles are ordered rare first, by a sketch of their document counts over the
whole corpus and then by hash: any fixed order gives all links, and a rare-first
one gives few candidates. Two classes can link only if they share a shingle of
their prefixes; a shingle whose counter was raised once is in one document alone
(a counter never falls short), so it leaves the prefix before anything is
shuffled, and a document that keeps none has no candidates at all. The length
filter, the positional filter on the shared shingle's places and the suffix
filter on the sets' counts by hash range drop most other pairs, and a pair that
is left is verified once, on the whole sets. These are written once, for the
classes that have candidates.

Large groups of near copies are not paired out. Of each prefix shingle and
length band, one class is verified against the others, another one in each
round, until a round finds no link; what links join is one component, and
shingles whose classes are all of one component are closed. The classes of the
shingles that stay open meet in blocks of about ``BLOCK``, and only pairs of
different components that pass all filters are verified, so no link between
components is lost and no task holds more than two blocks.

Defined results: null, empty and wordless texts have an empty set and are
linked with nothing; repeated rows are of one class; rows that share an id but
not a text are rows like any other; a null id is never a component's id unless
all of the component's ids are null; other columns are left out. Pairs inside a
component are not all verified: links are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, encoded, record, shuffles_removed, slices, written
from .hashing import WordHashes, rolled
from .sketches import level_of, sketch

#: The sketch that orders the shingles has a counter for each word of the corpus, up to so many; a quarter byte each is broadcast.
MAX_WIDTH = 1 << 29
#: Ranges of the hash by which the suffix filter counts a set.
RANGES = 128
#: Rounds of leaders, at most, before the pairs that are left are verified.
ROUNDS = 2
#: Classes of a shingle that meet in one block, and ways in which a leader's row is dealt.
BLOCK, SALTS = 256, 8
#: Classes that a task remembers having sent, and the bytes of a slice of texts.
SENT, SLICE = 100_000, 1_000_000
_TABLE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("prefix", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("parts", pa.binary()), ("shingles", pa.binary())])
_TABLE_DDL = "doc_id long, text_hash long, n long, sid binary, prefix array<long>, places array<int>, parts binary, shingles binary"
_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("la", pa.binary()), ("lb", pa.binary())])
_PAIRS_DDL = "a binary, b binary, la binary, lb binary"
PAIR = ["a", "b", "la", "lb"]


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    words = text.lower().split()
    return np.unique(rolled(hashes.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def set_id(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _sets_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = WordHashes(100_000)
    for b in slices(batches, 1, SLICE):
        yield b, [shingles(x, size, hashes) for x in encoded(b, 1)]


def range_counts(found: np.ndarray) -> bytes:
    """How many shingles are in each range of the hash: a byte each, or four where one is above 255."""
    counts = np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=RANGES)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


def _counts_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8 if len(blob) == RANGES else "<u4")


def prefix_length(n: int, percent: int) -> int:
    """Sets of n shingles that link have one of so many first ones in common, in any order of the shingles."""
    return n - -(-percent * n // 100) + 1


def _candidates(size: int, percent: int, shared, width: int):
    """For each row its set's size and id; for each class with a prefix shingle that may be shared, once in a task, these, their places and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, sent = shared.value, set()
        for b, sets in _sets_of(batches, size):
            out: list[list] = [[] for _ in range(5)]
            for s in sets:
                sid, rest = set_id(s), (None, None, None, None)
                if sid is not None and sid not in sent:
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(sid)
                    levels = level_of(packed, s, width)
                    first = np.argsort(levels, kind="stable")[: prefix_length(len(s), percent)]
                    at = np.nonzero(levels[first])[0]
                    if len(at):
                        rest = (s[first[at]].view(np.int64), at.astype(np.int32), range_counts(s), s.tobytes())
                for column, x in zip(out, (sid, *rest), strict=True):
                    column.append(x)
            yield record(_TABLE, b.column(0), b.column(2), [len(s) for s in sets], *out)

    return run


def least_overlap(na: Column, nb: Column, percent: int) -> Column:
    """The least intersection with which sets of these sizes link."""
    return F.ceil(percent * (na + nb) / F.lit(100 + percent) - F.lit(1e-9))


def _passes(na: Column, ia: Column, nb: Column, ib: Column, percent: int) -> Column:
    """Length filter, and positional filter for the first shingle that both prefixes hold."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - ia, nb - ib) >= least_overlap(na, nb, percent))


def _suffix(percent: int):
    """Of pairs (a, b, la, lb, na, nb, pa, pb), those whose counts by hash range allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            bound = np.fromiter((int(np.minimum(_counts_of(x), _counts_of(y)).sum()) for x, y in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True)), np.int64, b.num_rows)
            keep = pa.array((100 + percent) * bound >= percent * (na + nb))
            yield record(_PAIRS, *(b.column(c).filter(keep) for c in PAIR))

    return run


def _linked(percent: int):
    """Of pairs (a, b, la, lb, sa, sb), those that link, as verified on their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, last, held = [], None, None
            for sa, sb in zip(b.column("sa"), b.column("sb"), strict=True):
                if last is None or not sa.equals(last):
                    last, held = sa, np.frombuffer(sa.as_py(), np.uint64)
                y = np.frombuffer(sb.as_py(), np.uint64)
                both = int((held[np.minimum(np.searchsorted(held, y), len(held) - 1)] == y).sum())
                keep.append((100 + percent) * both >= percent * (len(held) + len(y)))
            yield record(_PAIRS, *(b.column(c).filter(pa.array(keep)) for c in PAIR))

    return run


def _verified(pairs: DataFrame, table: DataFrame, percent: int, filtered: bool) -> DataFrame:
    """The pairs (a, b, la, lb) that link; filtered: they have passed the suffix filter."""
    if not filtered:
        wide = pairs
        for side in "ab":
            wide = wide.join(_classes(table, pairs, "n", "parts").select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("parts").alias(f"p{side}")), side)
        pairs = written(wide.mapInArrow(_suffix(percent), _PAIRS_DDL))
    sets = _classes(table, pairs, "shingles")
    for side in "ba":
        pairs = pairs.join(sets.select(F.col("sid").alias(side), F.col("shingles").alias(f"s{side}")), side)
    return pairs.select(*PAIR, "sa", "sb").mapInArrow(_linked(percent), _PAIRS_DDL)


def _classes(table: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """The classes of the pairs, once each."""
    needed = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    return table.where("shingles is not null").select("sid", *columns).join(needed, "sid", "left_semi").dropDuplicates(["sid"])


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that each node of edges (a, b) reaches, by large-star and small-star rounds."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        # Large star: all larger neighbours of a node link to its least neighbour or itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = checkpointed(edges)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("least"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())


def _relabelled(df: DataFrame, joined: DataFrame) -> DataFrame:
    """df with its column least mapped by joined (node, least), where it is among the nodes."""
    new = joined.select(F.col("node").alias("least"), F.col("least").alias("_new"))
    return df.join(new, "least", "left").withColumn("least", F.coalesce("_new", "least")).drop("_new")


def _leaders(placed: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs (a, b, la, lb) of a class and the leader of one of its shingles and length bands, another leader in each round."""
    lead = placed.groupBy("token", "band").agg(F.min(F.struct(F.xxhash64("sid", F.lit(number)).alias("h"), "sid", "n", "at", "least")).alias("lead"), F.min("least").alias("x"), F.max("least").alias("y")).where("x <> y")
    lead = lead.select("token", "band", "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    near = placed.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")).join(lead, ["token", "band", "salt"]).where(F.col("least") != F.col("lead.least"))
    near = near.where(_passes(F.col("lead.n"), F.col("lead.at"), F.col("n"), F.col("at"), percent))
    first = F.col("sid") < F.col("lead.sid")
    pick = lambda x, y: F.when(first, x).otherwise(y)
    return near.select(pick(F.col("sid"), F.col("lead.sid")).alias("a"), pick(F.col("lead.sid"), F.col("sid")).alias("b"), pick(F.col("least"), F.col("lead.least")).alias("la"), pick(F.col("lead.least"), F.col("least")).alias("lb")).distinct()


def _met(percent: int):
    """Pairs of different components inside each group (token, x, y) of rows sorted by these; x and y are blocks, a pair of two blocks is of one row from each."""

    def pairs_of(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, at, side = (rows.column(c).to_numpy() for c in ("n", "at", "side"))
        one = np.nonzero(side == 0)[0]
        two = np.nonzero(side == 1)[0]
        if rows.column("x")[0].as_py() == rows.column("y")[0].as_py():
            i, j = np.triu_indices(len(n), 1)
        else:
            i, j = np.repeat(one, len(two)), np.tile(two, len(one))
        label = np.unique(np.array(rows.column("least").to_pylist(), object), return_inverse=True)[1]
        ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        ok &= (100 + percent) * np.minimum(n[i] - at[i], n[j] - at[j]) >= percent * (n[i] + n[j])
        i, j = i[ok], j[ok]
        if len(i):
            counts = np.stack([_counts_of(x).astype(np.uint32) for x in rows.column("parts").to_pylist()])
            bound = np.concatenate([np.minimum(counts[i[k : k + 8192]], counts[j[k : k + 8192]]).sum(1) for k in range(0, len(i), 8192)]).astype(np.int64)
            ok = (100 + percent) * bound >= percent * (n[i] + n[j])
            i, j = i[ok], j[ok]
        sid = np.array(rows.column("sid").to_pylist(), object)
        swap = sid[i] > sid[j] if len(i) else np.zeros(0, bool)
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        take = lambda c, k: rows.column(c).take(pa.array(k, pa.int64()))
        return record(_PAIRS, take("sid", i), take("sid", j), take("least", i), take("least", j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            key = [b.column(c).to_numpy() for c in ("token", "x", "y")]
            cuts = [0, *(np.nonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))[0] + 1).tolist()]
            for a, e in zip(cuts, cuts[1:]):
                if e - a > 1:
                    yield pairs_of(b.slice(a, e - a))
            rest = b.slice(cuts[-1])
        if rest is not None and rest.num_rows > 1:
            yield pairs_of(rest)

    return run


def _apart(placed: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, la, lb) of different components that share a prefix shingle and pass the filters."""
    sizes = placed.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    parts = table.where("shingles is not null").select("sid", "parts").join(placed.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])
    rows = placed.join(sizes, "token").join(parts, "sid").withColumn("own", F.pmod(F.xxhash64("sid", "token"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sid", "n", "at", "least", "parts")
    return rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(_met(percent), _PAIRS_DDL).distinct()


def _known(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(-(2**63)))


def _components_of(df: DataFrame, text: str, size: int, percent: int, width: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, n, sid), and of each class (sid) the smallest id that links reach."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    if width is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width = min(MAX_WIDTH, 1 << max(16, (n_bytes // 6).bit_length()))

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *(s for _, sets in _sets_of([batch], size) for s in sets)])

    order = spark.sparkContext.broadcast(sketch(rows, keys, rows=1, width=width, levels=True)[0])
    table = written(rows.mapInArrow(_candidates(size, percent, order, width), _TABLE_DDL))
    members = table.select("doc_id", "text_hash", "n", "sid")
    classes = table.where("shingles is not null").select("sid", "n", "prefix", "places").dropDuplicates(["sid"])
    placed = classes.select("sid", "n", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select(F.col("p.prefix").alias("token"), "sid", "n", F.col("p.places").alias("at"), F.floor(F.log(F.col("n").cast("double")) * 20).alias("band"), F.col("sid").alias("least"))
    placed = written(placed)

    # Rounds of leaders: in each, a class meets one class of each of its shingles and length bands.
    labels, tested = classes.select("sid", F.col("sid").alias("least")), None
    for number in range(ROUNDS):
        pairs = _leaders(placed, number, percent)
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        links = written(_verified(pairs, table, percent, False))
        found = not links.isEmpty()
        if found:
            joined = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            labels, placed = written(_relabelled(labels, joined)), _relabelled(placed, joined)
        if found or not number:
            unlike = placed.groupBy("token").agg(F.min("least").alias("x"), F.max("least").alias("y")).where("x <> y").select("token")
            placed = written(placed.join(unlike, "token", "left_semi"))
        if not found:
            break

    # Pairs of different components, all of them that share a prefix shingle.
    rest = written(_apart(placed, table, percent).join(tested, ["a", "b"], "left_anti"))
    links = written(_verified(rest, table, percent, True))
    if not links.isEmpty():
        labels = written(_relabelled(labels, components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))))

    own = members.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("_own")).join(labels, "sid", "left").withColumn("least", F.coalesce("least", "sid"))
    smallest = own.groupBy("least").agg(F.min("_own").alias("_component"))
    return members, own.join(smallest, "least").select("sid", "_component")


def link_documents(df: DataFrame, *, text: str = "text", size: int = 5, percent: int = 80, width: int | None = None, text_hashes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) for each row of df (doc_id, text); percent: the least similarity."""
    with shuffles_removed(df.sparkSession):
        members, ids = _components_of(df, text, size, percent, width)
    more = ["text_hash"] if text_hashes else []
    return members.join(ids, "sid", "left").select("doc_id", *more, F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, *, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that stay of each component: one, of its smallest id (and of the smallest text hash, where rows share that id), with all columns whatever their names; rows of a null id stay as they are."""
    linked = link_documents(df, text=text, size=size, percent=percent, text_hashes=True)
    kept = linked.where("doc_id = component_id").groupBy(F.col("doc_id").alias("own")).agg(F.min("text_hash").alias("own_hash"))
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    doc_id, body = (F.col(f"c{df.columns.index(c)}") for c in ("doc_id", text))
    known = plain.where(doc_id.isNotNull()).withColumn("hash", F.xxhash64(body)).join(kept, (doc_id.cast("long") == F.col("own")) & (F.col("hash") == F.col("own_hash")), "left_semi")
    once = known.dropDuplicates([f"c{df.columns.index('doc_id')}", "hash"]).drop("hash")
    return once.unionByName(plain.where(doc_id.isNull())).toDF(*df.columns)
