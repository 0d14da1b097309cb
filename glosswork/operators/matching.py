"""Wrong labels: missed and spurious spans that overlap and differ in label, one to one.

In each document the largest number of pairs is found by augmenting paths, gold
spans in order of start, end and label, their candidates by the ratio of overlap
to union, then start, end and label. Pairs never leave an overlap island, so each
island is matched by itself in Arrow batches. In an island of more than LAYERED
spans shortest paths are taken in rounds: there are as many pairs, which may be
of other spans. A span without a label pairs with nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import SPURIOUS, WRONG, Block, Decided, Row, _of_rows, blocks, decided, documents_of, hollow, in_order, joined, only, outcomes_of, shown, tally
from .spans import Span

LAYERED = 2000


def overlap_ratio(a: Span, b: Span) -> float:
    return max(0, min(a["e"], b["e"]) - max(a["s"], b["s"])) / (max(a["e"], b["e"]) - min(a["s"], b["s"]))


class Near:
    """Sorted predictions, found by overlap: how far those up to each reach says where to begin."""

    def __init__(self, ps: list[Span]):
        self.ps, self.starts, self.reach = ps, [p["s"] for p in ps], list(accumulate((p["e"] for p in ps), max))

    def candidates(self, g: Span) -> list[int]:
        """Predictions of another label that overlap g, the best first."""
        ps, low, high = self.ps, bisect_right(self.reach, g["s"]), bisect_left(self.starts, g["e"])
        near = [j for j in range(low, high) if g["s"] < ps[j]["e"] and None not in (g["lab"], ps[j]["lab"]) and ps[j]["lab"] != g["lab"]]
        return sorted(near, key=lambda j: (-overlap_ratio(g, ps[j]), j))


def largest_matching(edges: list[list[int]]) -> dict[int, int]:
    """right -> left of a largest matching; an augmenting path starts from each left node in turn.

    What a search saw in vain leads nowhere later either, and isn't looked at again.
    """
    owner: dict[int, int] = {}
    dead: set[int] = set()
    for start in range(len(edges)):
        seen, path, choices = set(), [], [iter(edges[start])]
        while choices:
            j = next((j for j in choices[-1] if j not in seen and j not in dead), None)
            if j is None:
                choices.pop()
                if path:
                    path.pop()
                continue
            seen.add(j)
            path.append(j)
            if j not in owner:  # shift the owners along the path
                left = [start, *(owner[k] for k in path[:-1])]
                owner.update(zip(path, left, strict=True))
                break
            choices.append(iter(edges[owner[j]]))
        else:
            dead |= seen
    return owner


def layered_matching(edges: list[list[int]]) -> dict[int, int]:
    """right -> left of a largest matching, by rounds: each finds how far nodes are from free left ones, and takes shortest paths that share none."""
    partner: list[int | None] = [None] * len(edges)
    owner: dict[int, int] = {}
    while True:
        level: dict[int, int] = {i: 0 for i, j in enumerate(partner) if j is None}
        layer, found = list(level), False
        while layer and not found:
            later = []
            for i in layer:
                for j in edges[i]:
                    if j not in owner:
                        found = True
                    elif owner[j] not in level:
                        level[owner[j]] = level[i] + 1
                        later.append(owner[j])
            layer = later
        if not found:
            return owner
        used: set[int] = set()
        choices = [iter(e) for e in edges]
        for start in [i for i, j in enumerate(partner) if j is None]:
            path: list[tuple[int, int]] = []
            at = start
            while True:
                j = next((j for j in choices[at] if j not in used and (j not in owner or level.get(owner[j]) == level[at] + 1)), None)
                if j is None:
                    if not path:
                        break
                    at = path.pop()[0]
                    continue
                used.add(j)
                path.append((at, j))
                if j not in owner:
                    for left, right in path:
                        partner[left], owner[right] = right, left
                    break
                at = owner[j]


def _rows(gs: list[Span], ps: list[Span]) -> Iterator[Row]:
    near = Near(ps)
    edges = [near.candidates(g) for g in gs] if gs and ps else []
    owner = largest_matching(edges) if len(gs) + len(ps) <= LAYERED else layered_matching(edges)
    paired = set(owner.values())
    for j, p in enumerate(ps):
        yield ("C", "wrong_label", gs[owner[j]], p) if j in owner else ("S", "spurious", None, p)
    for i, g in enumerate(gs):
        if i not in paired:
            yield "N", "missed", g, None


def _matched_block(block: Block) -> Decided:
    golds, preds, without = block.counts(block.gold), block.counts(~block.gold), block.unlabelled()
    # Islands of one side have no pairs; of one span on either side there is one pair, or none.
    single = (golds <= 1) & (preds <= 1)
    g, p, _ = block.pairs(single[block.island])
    differ = (block.lab[g] != block.lab[p]) & ~without[g] & ~without[p]
    g, p = g[differ], p[differ]
    left = (single | (golds == 0) | (preds == 0))[block.island]
    left[g] = left[p] = False
    missed, spurious = np.flatnonzero(left & block.gold), np.flatnonzero(left & ~block.gold)
    none = lambda x: np.full(len(x), -1, np.int64)
    parts = [(np.full(len(g), WRONG), g, p), (np.zeros(len(missed), np.int64), missed, none(missed)), (np.full(len(spurious), SPURIOUS), none(spurious), spurious)]
    for gs, ps in block.of_islands(np.flatnonzero(~single & (golds > 0) & (preds > 0)), np.ones(len(block.s), bool)):
        for x in (*gs, *ps):
            if without[x["row"]]:
                x["lab"] = None
        parts.append(_of_rows(_rows(gs, ps)))
    return joined(parts)


def corrected(outcomes: DataFrame) -> DataFrame:
    """outcomes in which each pair of a missed and a spurious span is one row C (wrong_label)."""
    side = lambda name, kind: outcomes.where(F.col("match_type") == kind).select("doc_id", *(F.col(f"{name}_{x}").alias(x) for x in ("s", "e", "lab")))
    missed, spurious = side("gold", "N"), side("pred", "S")
    spans, schema = in_order(missed, spurious)
    hollow = outcomes.where("(match_type = 'N' and coalesce(gold_s >= gold_e, true)) or (match_type = 'S' and coalesce(pred_s >= pred_e, true))")
    return outcomes.where("match_type in ('M', 'C')").unionByName(outcomes_of(spans, schema, _matched_block)).unionByName(hollow)


def wrong_labels(outcomes: DataFrame) -> DataFrame:
    """The pairs alone."""
    return corrected(outcomes).where("subtype = 'wrong_label'")


#: Ways to align: by two tiers, by labels alone, by labels with wrong ones corrected.
WAYS = ("tiers", "labels", "corrected")


def _left(block: Block, rows: np.ndarray) -> Block:
    """Some rows of a block, in order, with islands anew."""
    s, e, island = block.s[rows], block.e[rows], block.island[rows]
    low = int(s.min())
    width = int(e.max()) - low + 1
    before = np.concatenate([[-1], np.maximum.accumulate(island * width + e - low)])[: len(rows)]
    return Block(block.rows.take(pa.array(rows)), island * width + s - low >= before)


def _corrected(block: Block, found: Decided) -> Decided:
    """Outcomes of a block, wrong labels corrected where they lie."""
    kind, g, p = found
    free = (kind == 0) | (kind == SPURIOUS)
    rows = np.sort(np.where(g < 0, p, g)[free])
    if not len(rows):
        return found
    again, one, other = _matched_block(_left(block, rows))
    of_block = lambda x: np.where(x < 0, -1, rows[x])
    return joined([(kind[~free], g[~free], p[~free]), (again, of_block(one), of_block(other))])


def corrected_block(block: Block) -> Decided:
    """A block's spans aligned by labels alone, wrong ones corrected."""
    return _corrected(block, decided(block, two_tier=False))


def align_corrected(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """What corrected says of the outcomes by labels alone; spans are shuffled and sorted once for both."""
    spans, schema = in_order(gold, pred)
    return outcomes_of(spans, schema, corrected_block).unionByName(hollow(gold, pred))


def align_corrected_summed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The outcomes of align_corrected with n: the pairs of wrong labels as they are, the others as rows without spans that say how many they stand for."""
    spans, schema = in_order(gold, pred)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            kind, g, p = corrected_block(block)
            yield shown(block, *(x[kind == WRONG] for x in (kind, g, p)), np.ones((kind == WRONG).sum(), np.int64))
            n = np.bincount(kind[kind != WRONG], minlength=WRONG)
            some = np.flatnonzero(n)
            yield shown(block, some, np.full(len(some), -1), np.full(len(some), -1), n[some])

    return spans.mapInArrow(run, f"{schema}, n long").unionByName(hollow(gold, pred).withColumn("n", F.lit(1).cast("long")))


def align_wrong_labels(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The pairs of align_corrected alone."""
    spans, schema = in_order(gold, pred)
    return outcomes_of(spans, schema, only(corrected_block, WRONG))


def counts_by_document(gold: DataFrame, pred: DataFrame, ways: tuple[str, ...] = WAYS) -> DataFrame:
    """doc_id and, for each way, tiers_m, tiers_c, tiers_s, tiers_n and so on: how many outcomes of each kind it has.

    Spans are shuffled and sorted once, and each block of islands is aligned in all ways where it
    lies. A document of several blocks has a row for each; they are to be summed.
    """
    spans, _ = in_order(gold, pred)
    names = [f"{way}_{x}" for way in ways for x in "mcsn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids, doc = documents_of(block)
            sums, plain = {}, None
            for way in ways:
                if way == "tiers":
                    found = decided(block)
                else:
                    found = plain = plain or decided(block, two_tier=False)
                sums[way] = tally(_corrected(block, found) if way == "corrected" else found, doc, "MCSN")
            columns = np.concatenate([sums[way] for way in ways], axis=1).T
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], names=["doc_id", *names])

    kind = F.col("match_type")
    empty = hollow(gold, pred).groupBy("doc_id").agg(*(F.count_if(kind == name[-1].upper()).alias(name) for name in names))
    return spans.mapInArrow(run, ", ".join([f"doc_id {spans.schema['doc_id'].dataType.simpleString()}", *(f"{x} long" for x in names)])).unionByName(empty)
