"""Islands over stretches of a document, and what is done with long ones."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glosswork.operators import alignment, chunking, matching, spans

SPANS = "doc_id long, s int, e int, lab string"


def numbered(rows):
    """Islands of one document's spans, one span after another."""
    out, end, number = [], None, 0
    for s, e, lab in sorted(rows, key=lambda x: x[:2]):
        number += end is None or s >= end
        end = e if end is None else max(end, e)
        out.append((s, e, lab, number))
    return sorted(out)


@pytest.mark.parametrize("stretch", [None, 5, 40, 1 << 20])
def test_islands_of_random_spans(spark, stretch):
    r = random.Random(stretch or 1)
    docs = {i: [(s := r.randrange(r.choice([30, 300])), s + r.choice([1, 2, 5, 60]), r.choice("ab")) for _ in range(r.randint(1, 30))] for i in range(60)}
    df = spark.createDataFrame([(i, *x) for i, d in docs.items() for x in d], SPANS)
    got = {}
    for x in spans.with_islands(df, stretch=stretch).collect():
        got.setdefault(x.doc_id, []).append((x.s, x.e, x.lab, x.island))
    assert {i: sorted(x) for i, x in got.items()} == {i: numbered(d) for i, d in docs.items()}
    flat = {x.doc_id: x.disjoint for x in spans.overlaps_nowhere(df, stretch=stretch).collect()}
    assert flat == {i: len({x[3] for x in numbered(d)}) == len(d) for i, d in docs.items()}
    assert spans.with_islands(df.limit(0), stretch=stretch).count() == 0


def test_a_giant_document_is_sorted_by_all_tasks(spark):
    n, parts = 1_000_000, 8
    df = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 30).cast("int").alias("s"), (F.col("id") * 30 + 20 + F.col("id") % 2 * 20).cast("int").alias("e"), F.lit("a").alias("lab"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = spans.with_islands(df, stretch=1 << 16).withColumn("task", F.spark_partition_id())
        rows = found.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("island").alias("last")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Each odd span runs into the next one: two spans an island.
    assert len(rows) == parts and max(r.n for r in rows) < n / 4 and max(r.last for r in rows) == n // 2 + 1 - n % 2


CHAIN = [(2 * i, 2 * i + 3) for i in range(50_000)]


def test_long_chains_take_seconds(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(1, s, e + r.randrange(3), "a") for s, e in CHAIN], SPANS).withColumn("margin", F.col("s") % 7)
    for found in (spans.longest_first(df.drop("margin")), chunking.dedupe_margin(df), spans.dedupe_longest(df.drop("margin"))):
        began = time.time()
        assert 10_000 < found.count() < 50_000 and time.time() - began < 60
    pred = df.select("doc_id", (F.col("s") + F.col("s") % 3).cast("int").alias("s"), "e", "lab")
    began = time.time()
    counts = {x.match_type: x["count"] for x in alignment.align_legacy(df.drop("margin"), pred).groupBy("match_type").count().collect()}
    assert counts["M"] + counts["C"] + counts.get("N", 0) == 50_000 and time.time() - began < 60


def test_short_and_long_islands_give_the_same(spark):
    r = random.Random(5)
    docs = {i: [(s := r.randrange(40), s + r.randint(1, 9), r.choice("ab"), r.randrange(9)) for _ in range(r.randint(1, 25))] for i in range(40)}
    df = spark.createDataFrame([(i, *x) for i, d in docs.items() for x in d], f"{SPANS}, margin int")
    assert sorted(map(tuple, chunking.dedupe_margin(df, folded=0).collect())) == sorted(map(tuple, chunking.dedupe_margin(df, folded=1000).collect()))
    for rows in docs.values():
        ordered = sorted({x[:3] for x in rows}, key=lambda x: (x[0] - x[1], *x[:3]))
        kept, plain = [(x["s"], x["e"]) for x in spans._longest_apart([{"s": s, "e": e, "lab": lab} for s, e, lab in ordered])], []
        for s, e, _ in ordered:
            if all(e <= a or b <= s for a, b in plain):
                plain.append((s, e))
        assert kept == plain


def test_alignment_by_stretches_is_the_same(spark):
    r = random.Random(11)
    side = lambda: spark.createDataFrame([(i % 5, s := r.randrange(300), s + r.randint(1, 30), r.choice("ab")) for i in range(300)], SPANS)
    gold, pred = side(), side()
    whole, parted = (sorted(map(repr, alignment.align(gold, pred, stretch=n).collect())) for n in (None, 16))
    assert whole == parted


def test_matchings_are_as_large_by_either_way():
    r = random.Random(7)
    span = lambda n: {"s": (s := r.randrange(n)), "e": s + r.randint(1, 6), "lab": r.choice([*"abc", None])}
    for _ in range(300):
        gs, ps = (sorted((span(25) for _ in range(r.randint(0, 14))), key=lambda x: (x["s"], x["e"], str(x["lab"]))) for _ in range(2))
        near = matching.Near(ps)
        edges = [near.candidates(g) for g in gs]
        plain = [[j for j, p in enumerate(ps) if p["s"] < g["e"] and g["s"] < p["e"] and None not in (g["lab"], p["lab"]) and g["lab"] != p["lab"]] for g in gs]
        assert [sorted(e) for e in edges] == plain
        one, other = matching.largest_matching(edges), matching.layered_matching(edges)
        assert len(one) == len(other) and len(set(other.values())) == len(other) and all(j in edges[i] for j, i in other.items())


def test_wrong_labels_of_a_long_chain(spark):
    # Each missed span likes best what the one before has taken.
    rows = [(1, "N", "missed", s, e, "a", None, None, None) for s, e in CHAIN] + [(1, "S", "spurious", None, None, None, s - 1, e - 1, "b") for s, e in CHAIN]
    df = spark.createDataFrame(rows, "doc_id long, match_type string, subtype string, gold_s int, gold_e int, gold_lab string, pred_s int, pred_e int, pred_lab string")
    began = time.time()
    counts = {x.match_type: x["count"] for x in matching.corrected(df).groupBy("match_type").count().collect()}
    assert counts == {"C": 50_000} and time.time() - began < 60


def test_counts_in_three_ways_at_once_are_those_of_the_outcomes(spark):
    r = random.Random(8)
    side = lambda: [(r.choice([None, *range(40)]), s := r.randrange(60), s + r.choice([0, 1, 4, 12, 30]), r.choice(["a", "b", "c", None])) for _ in range(700)]
    gold, pred = (spark.createDataFrame(side(), SPANS) for _ in range(2))
    labels = alignment.align(gold, pred, two_tier=False)
    each = {"tiers": alignment.align(gold, pred), "labels": labels, "corrected": matching.corrected(labels)}
    found = matching.counts_by_document(gold, pred)
    got = {x["doc_id"]: x.asDict() for x in found.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in found.columns[1:])).collect()}
    for way, outcomes in each.items():
        expected = {x["doc_id"]: [x[k] for k in "MCSN"] for x in outcomes.groupBy("doc_id").agg(*(F.count_if(F.col("match_type") == k).alias(k) for k in "MCSN")).collect()}
        assert {d: [x[f"{way}_{k}"] for k in "mcsn"] for d, x in got.items()} == expected
    assert None not in got and sum(x["corrected_c"] - x["labels_c"] for x in got.values()) > 20


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_older_scorer_counts_where_spans_lie(spark):
    r = random.Random(9)
    side = lambda: [(r.choice([None, *range(40)]), s := r.randrange(60), s + r.choice([0, 1, 4, 12, 30]), r.choice(["a", "b", None])) for _ in range(700)]
    gold, pred = (spark.createDataFrame(side(), SPANS).distinct() for _ in range(2))
    found = alignment.legacy_counts(gold, pred)
    each = alignment.align_legacy(gold, pred).groupBy("doc_id", "match_type").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, each.collect()))
    assert "gold_s" not in plan_of(found)  # outcomes of single spans never leave a task


def test_documents_of_one_hash_are_told_apart():
    import pyarrow as pa

    r = random.Random(10)
    rows = [(r.choice("xyz"), s := r.randrange(400), s + r.randint(1, 9), r.choice([None, 1, 2]), r.random() < 0.5) for _ in range(500)]
    names = ["doc_id", "s", "e", "lab", "_gold"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def said(rows, size, **more):
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)), *map(pa.array, more.values())], names=[*names, *more])
        found = []
        for block in alignment.blocks(batch.slice(at, size) for at in range(0, len(rows), size)):
            rank = lambda i: None if i < 0 else tuple(block.rows.column(c)[i].as_py() for c in names)  # noqa: B023, E731
            found += [(int(k), rank(g), rank(p)) for k, g, p in zip(*alignment.decided(block), strict=True)]
        return sorted(found, key=repr)

    # x and y share a hash.
    at = lambda x: ((x[0] == "z") << 32) | (x[1] + (1 << 31))
    mixed = sorted(rows, key=at)
    whole = said(sorted(rows, key=lambda x: (*x[:3], x[3] or 0, x[4])), 1000)
    assert all(said(mixed, size, _at=[at(x) for x in mixed]) == whole for size in (1000, 64, 3))


def test_spans_are_sorted_by_one_number(spark):
    spans, _ = alignment.in_order(*(spark.createDataFrame([(1, 2, 3, "a")], SPANS) for _ in range(2)))
    [sort] = [x for x in plan_of(spans).splitlines() if "Sort [" in x]
    assert sort.count("ASC") == 1
