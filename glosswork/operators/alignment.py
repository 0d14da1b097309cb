"""Greedy alignment of gold and predicted spans.

Gold spans go in order of start, end and label. Each takes the free prediction
that equals it; else the one of its label with the largest overlap; else, with
two tiers, the one of another label with the largest overlap; the first on
ties. Spans of different overlap islands never meet. Spark brings a document's
spans together in order, and islands are aligned as they go by in Arrow batches:
short ones side by side, the first gold span of each, then the second, and so on;
longer ones by themselves, where a gold span looks only at the free predictions
that it overlaps. Only an island is held whole.

Defined results: null labels are equal to each other and to nothing else; gold
spans that hold nothing (s >= e, or a null offset) are missed and such
predictions spurious; rows of a null document are left out; repeated spans are
aligned one by one; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, IntegralType, ShortType, StringType

from .spans import FOLDED, Span, with_islands

KINDS = {3: ("M", "exact"), 2: ("C", "boundary"), 1: ("C", "class_confusion"), 0: ("N", "missed")}
Row = tuple[str, str, Span | None, Span | None]
#: Outcomes by number: the tiers first.
NAMES = [*(KINDS[t] for t in range(4)), ("S", "spurious"), ("C", "wrong_label"), ("X", "again")]
CONFUSED, SPURIOUS, WRONG, AGAIN = 1, 4, 5, 6


def _changes(values: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    if pa.types.is_struct(values.type):
        return np.logical_or.reduce([_changes(x) for x in values.flatten()])
    one, other = values[1:], values[:-1]
    differ = pc.fill_null(pc.not_equal(one, other), False).to_numpy(zero_copy_only=False)
    return differ | (one.is_null().to_numpy(zero_copy_only=False) != other.is_null().to_numpy(zero_copy_only=False))


class Block:
    """Whole islands of sorted spans: rows with s, e, lab (numbers, equal where the labels are), gold and the number of their island."""

    def __init__(self, rows: pa.RecordBatch, opens: np.ndarray):
        self.rows, self.begins, self.island = rows, np.flatnonzero(opens), np.cumsum(opens) - 1
        self.s, self.e = (rows.column(x).to_numpy().astype(np.int64) for x in ("s", "e"))
        self.lab = pc.dictionary_encode(rows.column("lab"), null_encoding="encode").indices.to_numpy()
        self.gold = rows.column("_gold").to_numpy(zero_copy_only=False)

    def unlabelled(self) -> np.ndarray:
        return self.rows.column("lab").is_null().to_numpy(zero_copy_only=False)

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Rows of the mask in each island."""
        return np.bincount(self.island[mask], minlength=len(self.begins))

    def spans(self, at: np.ndarray) -> list[Span]:
        """Rows as spans, with their number as row."""
        return [{"s": s, "e": e, "lab": lab, "row": i} for s, e, lab, i in zip(self.s[at].tolist(), self.e[at].tolist(), self.lab[at].tolist(), at.tolist(), strict=True)]

    def of_islands(self, islands: np.ndarray, among: np.ndarray) -> Iterator[tuple[list[Span], list[Span]]]:
        """Gold and predicted spans among some rows, an island at a time."""
        ends = np.append(self.begins[1:], len(self.s))
        for k in islands:
            at = np.arange(self.begins[k], ends[k])
            at = at[among[at]]
            yield self.spans(at[self.gold[at]]), self.spans(at[~self.gold[at]])

    def pairs(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the gold and predicted spans among some rows that overlap, and the place of the gold span in its island."""
        gs, ps = np.flatnonzero(among & self.gold), np.flatnonzero(among & ~self.gold)
        first, n = np.searchsorted(self.island[ps], self.island[gs]), self.counts(among & ~self.gold)[self.island[gs]]
        place = np.arange(len(gs)) - np.searchsorted(self.island[gs], self.island[gs])
        owner = np.repeat(np.arange(len(gs)), n)
        p = ps[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]] if len(owner) else np.empty(0, np.int64)
        g = gs[owner]
        met = np.minimum(self.e[g], self.e[p]) > np.maximum(self.s[g], self.s[p])
        return g[met], p[met], place[owner[met]]


#: The number of each outcome, and the rows of its gold and predicted span, -1 for none.
Decided = tuple[np.ndarray, np.ndarray, np.ndarray]


def _opened(new: np.ndarray, s: np.ndarray, e: np.ndarray, reach: int) -> tuple[np.ndarray, int]:
    """Of sorted spans, where new marks the first of each document, those that open an island, and how far the last document's reach; reach: how far those before did."""
    doc = np.cumsum(new) - new[0]
    low = min(int(s.min()), int(e.min()) if new[0] else reach)
    width = max(int(e.max()), low if new[0] else reach) - low + 1
    ends = np.maximum.accumulate(np.concatenate([[-1 if new[0] else reach - low], doc * width + e - low]))
    return doc * width + s - low >= ends[:-1], int(ends[-1] - doc[-1] * width + low)


def _put_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come by _at as blocks takes them. Documents of one hash lie among each other until a place that no span of theirs crosses."""
    held: list[pa.RecordBatch] = []
    last, reach = None, 0

    def ordered() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        doc, lab = rows.column("doc_id").dictionary_encode().indices.to_numpy().astype(np.int64), pc.rank(rows.column("lab"), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        own = lab * 2 + rows.column("_gold").to_numpy(zero_copy_only=False)
        order = np.lexsort((own, rows.column("e").to_numpy(), doc << 32 | rows.column("_at").to_numpy() & 0xFFFFFFFF))
        return rows.drop_columns(["_at"]).take(pa.array(order))

    for b in batches:
        if "_at" not in b.schema.names:
            yield b
            continue
        if not b.num_rows:
            continue
        hashes = b.column("_at").to_numpy() >> 32
        new = np.concatenate([[last is None or hashes[0] != last], hashes[1:] != hashes[:-1]])
        apart, reach = _opened(new, *(b.column(x).to_numpy().astype(np.int64) for x in ("s", "e")), reach)
        last = hashes[-1]
        cut = int(np.flatnonzero(apart)[-1]) if apart.any() else -1
        if cut > 0:
            held.append(b.slice(0, cut))
        if cut >= 0:
            if held:
                yield ordered()
            held = []
        held.append(b.slice(max(cut, 0)))
    if held:
        yield ordered()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Whole islands of rows that come by document, start and end, or by _at; the last island is held until the next begins."""
    held: list[tuple[pa.RecordBatch, np.ndarray]] = []
    last, reach = None, 0

    def whole() -> Block:
        return Block(pa.Table.from_batches([b for b, _ in held]).combine_chunks().to_batches()[0], np.concatenate([o for _, o in held]))

    for b in _put_in_order(batches):
        if not b.num_rows:
            continue
        s, e = (b.column(x).to_numpy().astype(np.int64) for x in ("s", "e"))
        docs = b.column("doc_id")
        new = np.concatenate([[True] if last is None else _changes(pa.concat_arrays([last, docs[:1]])), _changes(docs)])
        opens, reach = _opened(new, s, e, reach)
        last = docs[-1:]
        if opens.any():
            cut = int(np.flatnonzero(opens)[-1])
            if cut:
                held.append((b.slice(0, cut), opens[:cut]))
            if held:
                yield whole()
            held = [(b.slice(cut), opens[cut:])]
        else:
            held.append((b, opens))
    if held:
        yield whole()


def shown(block: Block, kind: np.ndarray, g: np.ndarray, p: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """Outcomes as rows, with a column n if there is more. An outcome of neither span has no document."""
    names = ["doc_id", "match_type", "subtype", *(f"{side}_{x}" for side in ("gold", "pred") for x in ("s", "e", "lab")), "n"]
    words, at = [pa.array([x[i] for x in NAMES]) for i in range(2)], lambda x: pa.array(x, pa.int64(), mask=x < 0)
    sides = [block.rows.column(x).take(at(side)) for side in (g, p) for x in ("s", "e", "lab")]
    columns = [block.rows.column("doc_id").take(at(np.where(g < 0, p, g))), *(w.take(pa.array(kind)) for w in words), *sides, *map(pa.array, more)]
    return pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])


def outcomes_of(spans: DataFrame, schema: str, decide: Callable[[Block], Decided]) -> DataFrame:
    """What decide says of the islands of sorted spans, as rows of outcomes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = decide(block)
            for at in range(0, len(found[0]), 10_000):
                yield shown(block, *(x[at : at + 10_000] for x in found))

    return spans.mapInArrow(run, schema)


def only(decide: Callable[[Block], Decided], *kinds: int) -> Callable[[Block], Decided]:
    """decide, of whose outcomes some kinds alone are shown."""

    def run(block: Block) -> Decided:
        found = decide(block)
        shown = np.isin(found[0], kinds)
        return tuple(x[shown] for x in found)

    return run


def documents_of(block: Block) -> tuple[pa.Array, np.ndarray]:
    """The ids of a block's documents, in order, and which of them each row is of."""
    ids = block.rows.column("doc_id")
    new = np.concatenate([[True], _changes(ids)])
    return ids.filter(pa.array(new)), np.cumsum(new) - 1


def tally(found: Decided, doc: np.ndarray, kinds: str) -> np.ndarray:
    """How many outcomes of each of the kinds, among which all are, each document has."""
    kind, g, p = found
    at = np.array([kinds.find(x) for x, _ in NAMES])[kind]
    return np.bincount(doc[np.where(g < 0, p, g)] * len(kinds) + at, minlength=len(kinds) * (int(doc[-1]) + 1)).reshape(-1, len(kinds))


def in_order(gold: DataFrame, pred: DataFrame, stretch: int | None = None) -> tuple[DataFrame, str]:
    """The spans that hold something (doc_id, s, e, lab, _gold) as blocks takes them, and the schema of outcomes; with _at, the documents' hash and the start, where these fit in one number."""
    both = gold.select("doc_id", "s", "e", "lab", F.lit(True).alias("_gold")).unionByName(pred.select("doc_id", "s", "e", "lab", F.lit(False).alias("_gold")))
    kind = {f.name: f.dataType.simpleString() for f in both.schema}
    sides = ", ".join(f"{side}_{x} {kind[x]}" for side in ("gold", "pred") for x in ("s", "e", "lab"))
    rows, keys = both.where("doc_id is not null and s < e"), ["doc_id"]
    if stretch is not None:
        rows, keys = with_islands(rows, stretch=stretch), ["doc_id", "island"]
    if stretch is None and isinstance(both.schema["s"].dataType, (ByteType, ShortType, IntegerType)) and all(isinstance(both.schema[x].dataType, (IntegralType, StringType)) for x in ("doc_id", "lab")):
        # One number, which Spark sorts by its bits; the rest is put in order batch by batch.
        at = F.shiftleft(F.shiftright(F.xxhash64("doc_id"), 32), 32).bitwiseOR(F.col("s").cast("long") + (1 << 31))
        ordered = rows.repartition(*keys).withColumn("_at", at).sortWithinPartitions("_at")
    else:
        ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "s", "e", "lab", "_gold").select(*both.columns)
    return ordered, f"doc_id {kind['doc_id']}, match_type string, subtype string, {sides}"


def _first_of_each(g: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]


def _in_rounds(block: Block, g: np.ndarray, p: np.ndarray, place: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs by place, gold span and preference: the numbers of those that are taken; which predictions are, and which pairs took one that was (only where again)."""
    taken, chosen, twice = np.zeros(len(block.s), bool), [], []
    bounds = np.searchsorted(place, np.arange(int(place[-1]) + 2)) if len(place) else [0]
    for low, high in zip(bounds, bounds[1:], strict=False):
        at = np.arange(low, high)
        at = at[again[at] | ~taken[p[at]]]
        at = at[_first_of_each(g[at])]
        twice.append(at[taken[p[at]]])
        taken[p[at]] = True
        chosen.append(at)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *chosen]), taken, np.concatenate([none, *twice])


def _decided(block: Block, g: np.ndarray, kinds: np.ndarray, p: np.ndarray, taken: np.ndarray, among: np.ndarray) -> Decided:
    """Outcomes of the rows among: chosen pairs, gold spans without one, and predictions that aren't taken."""
    missed = among & block.gold
    missed[g] = False
    missed, free = np.flatnonzero(missed), np.flatnonzero(among & ~block.gold & ~taken)
    lacks = lambda x: np.full(len(x), -1, np.int64)
    return np.concatenate([kinds, np.zeros(len(missed), np.int64), np.full(len(free), SPURIOUS)]), np.concatenate([g, missed, lacks(free)]), np.concatenate([p, lacks(missed), free])


def _of_rows(found: Iterator[Row]) -> Decided:
    number = {x: i for i, x in enumerate(NAMES)}
    rows = [(number[kind, subtype], g["row"] if g else -1, p["row"] if p else -1) for kind, subtype, g, p in found]
    return tuple(np.array(rows, np.int64).reshape(-1, 3).T)


def joined(parts: list[Decided]) -> Decided:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def decided(block: Block, two_tier: bool = True, folded: int = FOLDED) -> Decided:
    """The greedy alignment of a block's islands."""
    short = np.diff(np.append(block.begins, len(block.s))) <= folded
    among, every = short[block.island], np.ones(len(block.s), bool)
    g, p, place = block.pairs(among)
    same = block.lab[g] == block.lab[p]
    tier = np.where(same & (block.s[g] == block.s[p]) & (block.e[g] == block.e[p]), 3, np.where(same, 2, int(two_tier)))
    g, p, place, tier = (x[tier > 0] for x in (g, p, place, tier))
    order = np.lexsort((p, np.maximum(block.s[g], block.s[p]) - np.minimum(block.e[g], block.e[p]), -tier, g, place))
    g, p, place, tier = (x[order] for x in (g, p, place, tier))
    chosen, taken, _ = _in_rounds(block, g, p, place, np.zeros(len(g), bool))
    parts = [_decided(block, g[chosen], tier[chosen], p[chosen], taken, among)]
    return joined(parts + [_of_rows(greedy(gs, ps, two_tier)) for gs, ps in block.of_islands(np.flatnonzero(~short), every)])


def _legacy_block(block: Block, folded: int = FOLDED) -> Decided:
    """Of equal spans of one side the first is looked at, and the others are left out."""
    equal = lambda x: np.concatenate([[False], x[1:] == x[:-1]])
    single = ~(equal(block.island) & equal(block.s) & equal(block.e) & equal(block.lab) & equal(block.gold))
    short = np.diff(np.append(block.begins, len(block.s))) <= folded
    among = short[block.island] & single
    g, p, place = block.pairs(among)
    order = np.lexsort((p, g, place))
    g, p, place = (x[order] for x in (g, p, place))
    same = block.lab[g] == block.lab[p]
    exact = same & (block.s[g] == block.s[p]) & (block.e[g] == block.e[p])
    chosen, taken, twice = _in_rounds(block, g, p, place, exact)
    parts = [_decided(block, g[chosen], np.where(exact, 3, np.where(same, 2, 1))[chosen], p[chosen], taken, among)]
    parts.append((np.full(len(twice), AGAIN), np.full(len(twice), -1, np.int64), p[twice]))
    return joined(parts + [_of_rows(legacy(gs, ps)) for gs, ps in block.of_islands(np.flatnonzero(~short), single)])


class Free:
    """Predictions in order that aren't taken; those that end before the gold spans to come are passed over for good."""

    def __init__(self, ps: list[Span]):
        self.ps, self.starts, self.next = ps, [p["s"] for p in ps], list(range(1, len(ps) + 1))
        self.head, self.taken = 0, [False] * len(ps)

    def over(self, g: Span) -> Iterator[int]:
        """Numbers of the free predictions that overlap g, in order; gold spans come by start."""
        stop, before, j = bisect_left(self.starts, g["e"]), -1, self.head
        while j < stop:
            if self.taken[j] or self.ps[j]["e"] <= g["s"]:
                j = self.next[j]
                if before < 0:
                    self.head = j
                else:
                    self.next[before] = j
                continue
            yield j
            before, j = j, self.next[j]


def greedy(gs: list[Span], ps: list[Span], two_tier: bool) -> Iterator[Row]:
    """The alignment of one island's sorted spans."""
    free = Free(ps)
    for g in gs:
        best = (0, 0, 0)
        for j in free.over(g):
            p = ps[j]
            same = p["lab"] == g["lab"]
            tier = 3 if same and p["s"] == g["s"] and p["e"] == g["e"] else 2 if same else int(two_tier)
            best = max(best, (tier, min(p["e"], g["e"]) - max(p["s"], g["s"]), -j)) if tier else best
        if best[0]:
            free.taken[-best[2]] = True
        yield *KINDS[best[0]], g, ps[-best[2]] if best[0] else None
    for j, p in enumerate(ps):
        if not free.taken[j]:
            yield "S", "spurious", None, p


def legacy(gs: list[Span], ps: list[Span]) -> Iterator[Row]:
    """The older scorer on an island's distinct spans: a gold span takes the first prediction in order that equals it, taken or not, or overlaps it and is free."""
    taken, free = [False] * len(ps), Free(ps)
    same = {(p["s"], p["e"], p["lab"]): j for j, p in enumerate(ps)}
    for g in gs:
        equal, over = same.get((g["s"], g["e"], g["lab"])), next(free.over(g), None)
        if equal is not None and (over is None or equal <= over):
            hit = ("M", "exact", equal)
        elif over is not None:
            hit = ("C", "boundary" if ps[over]["lab"] == g["lab"] else "class_confusion", over)
        else:
            yield "N", "missed", g, None
            continue
        if taken[hit[2]]:
            yield "X", "again", None, ps[hit[2]]
        taken[hit[2]] = free.taken[hit[2]] = True
        yield hit[0], hit[1], g, ps[hit[2]]
    for j, p in enumerate(ps):
        if not taken[j]:
            yield "S", "spurious", None, p


def hollow(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Outcomes of spans that hold nothing."""
    hollow, null = "doc_id is not null and coalesce(s >= e, true)", F.lit(None)
    own = lambda side: [F.col(x).alias(f"{side}_{x}") for x in ("s", "e", "lab")]
    other = lambda side, df: [null.cast(df.schema[x].dataType).alias(f"{side}_{x}") for x in ("s", "e", "lab")]
    missed = gold.where(hollow).select("doc_id", F.lit("N").alias("match_type"), F.lit("missed").alias("subtype"), *own("gold"), *other("pred", pred))
    return missed.unionByName(pred.where(hollow).select("doc_id", F.lit("S").alias("match_type"), F.lit("spurious").alias("subtype"), *other("gold", gold), *own("pred")))


def align(gold: DataFrame, pred: DataFrame, *, two_tier: bool = True, folded: int = FOLDED, stretch: int | None = None) -> DataFrame:
    """Outcomes: doc_id, match_type (M, C, S, N), subtype, gold_s, gold_e, gold_lab, pred_s, pred_e, pred_lab; stretch as in with_islands."""
    spans, schema = in_order(gold, pred, stretch)
    return outcomes_of(spans, schema, lambda block: decided(block, two_tier, folded)).unionByName(hollow(gold, pred))


def align_only(gold: DataFrame, pred: DataFrame, *kinds: int) -> DataFrame:
    """The outcomes of align that are of some kinds of pairs; others never leave a task."""
    spans, schema = in_order(gold, pred)
    return outcomes_of(spans, schema, only(decided, *kinds))


def _legacy_outcomes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Outcomes of the older scorer, with a row X for each time that a prediction was taken again."""
    spans, schema = in_order(gold, pred)
    return outcomes_of(spans, schema, _legacy_block)


def align_legacy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Outcomes of the older scorer, on distinct spans (doc_id, s, e, lab)."""
    # A document's predictions less its matches count as spurious: one that was taken twice makes up for a free one.
    order = Window.partitionBy("doc_id", "match_type").orderBy("pred_s", "pred_e", "pred_lab")
    again = F.count_if(F.col("match_type") == "X").over(Window.partitionBy("doc_id"))
    found = _legacy_outcomes(gold, pred).withColumns({"_again": again, "_place": F.row_number().over(order)})
    return found.where("match_type <> 'X' and (match_type <> 'S' or _place > _again)").drop("_again", "_place")


def legacy_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, match_type, n: how many outcomes of each kind align_legacy has for a document."""
    kinds = "MCNSX"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids, doc = documents_of(block)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, tally(_legacy_block(block), doc, kinds).T)], names=["doc_id", *kinds])

    # A document of several blocks has a row for each.
    spans, _ = in_order(gold, pred)
    each = spans.mapInArrow(run, ", ".join([f"doc_id {spans.schema['doc_id'].dataType.simpleString()}", *(f"{x} long" for x in kinds)]))
    found = each.groupBy("doc_id").agg(*(F.sum(x).alias(x) for x in kinds))
    return found.withColumn("S", F.greatest(F.col("S") - F.col("X"), F.lit(0))).drop("X").unpivot("doc_id", list("MCNS"), "match_type", "n").where("n > 0")
