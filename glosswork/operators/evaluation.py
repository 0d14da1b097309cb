"""Aggregates of alignment outcomes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from math import exp, factorial
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import adapted, exact_only, f1, ratio, strict
from ..functions.text import single_spaced
from .alignment import NAMES, Block, blocks, decided, hollow, in_order


def counts() -> list[Column]:
    return [F.count_if(F.col("match_type") == x).alias(x.lower()) for x in "MCSN"]


def scored(df: DataFrame, digits: int = 6) -> DataFrame:
    """df (m, c, s, n) with strict and adapted precision, recall and F1, rounded."""
    columns = [F.col(x) for x in "mcsn"]
    names = [f"{kind}_{x}" for kind in ("strict", "adapted") for x in ("p", "r", "f1")]
    return df.withColumns({k: F.round(v, digits) for k, v in zip(names, (*strict(*columns), *adapted(*columns)), strict=True)})


def scored_exact(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with precision, recall and F1 that leave conflated spans out."""
    return df.withColumns({f"exact_{k}": F.round(v, digits) for k, v in zip(("p", "r", "f1"), exact_only(*(F.col(x) for x in "mcsn")), strict=True)})


def by_label(outcomes: DataFrame) -> DataFrame:
    """Counts by the gold label, spurious spans by the predicted one."""
    return scored(outcomes.groupBy(F.coalesce("gold_lab", "pred_lab").alias("lab")).agg(*counts()))


def by_category(outcomes: DataFrame, categories: DataFrame) -> DataFrame:
    """Counts by category (lab, category); an outcome counts for each category that its gold or predicted label has."""
    for side in ("gold", "pred"):
        one = categories.select(F.col("lab").alias(f"{side}_lab"), F.col("category").alias(f"_{side}"))
        outcomes = outcomes.join(F.broadcast(one), f"{side}_lab", "left")
    each = outcomes.withColumn("category", F.explode(F.array_distinct(F.array_compact(F.array("_gold", "_pred")))))
    return scored(each.groupBy("category").agg(*counts()))


def subtype_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("match_type", "subtype").agg(F.count(F.lit(1)).alias("n"))


def pooled(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Micro scores of the outcomes pooled by keys."""
    return scored(outcomes.groupBy(*keys).agg(*counts()))


def summary(runs: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Mean and sample deviation (0 for a single run) of the F1 scores of runs."""
    out = [F.count(F.lit(1)).alias("runs")]
    for x in ("strict_f1", "adapted_f1"):
        out += [F.round(F.avg(x), digits).alias(f"{x}_mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), digits).alias(f"{x}_sd")]
    return runs.groupBy(*keys).agg(*out)


def confusions(outcomes: DataFrame) -> DataFrame:
    """How often each gold label was taken for each other label."""
    return outcomes.where("subtype = 'class_confusion'").groupBy("gold_lab", "pred_lab").agg(F.count(F.lit(1)).alias("n"))


def agreement(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa of pairs (a, b), from their table of labels alone."""
    table = pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = table.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")), table.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    chance = rows.join(columns, "k").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("both"))
    po, pe = F.col("same") / F.col("n"), F.col("both") / (F.col("n").cast("double") * F.col("n"))
    return total.join(chance).select("n", F.round(po, digits).alias("observed"), F.round(pe, digits).alias("expected"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), digits).alias("kappa"))


def term_frequencies(outcomes: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """term, n: what texts (doc_id, text) hold at the gold spans of outcomes of some pairs (gold_lab, pred_lab), in lower case and with single blanks; empty terms, and documents without a text, don't count."""
    wrong = outcomes.join(pairs.select("gold_lab", "pred_lab"), ["gold_lab", "pred_lab"], "left_semi").join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id")
    term = single_spaced(F.substring("_text", F.col("gold_s") + 1, F.col("gold_e") - F.col("gold_s")))
    return wrong.select(term.alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _in_version(block: Block, codes: np.ndarray) -> Block:
    """The block's spans under other labels, less those of a negative one, in order and with islands anew."""
    rows = np.flatnonzero(codes >= 0)
    rows = rows[np.lexsort((block.gold[rows], codes[rows], block.e[rows], block.s[rows], block.island[rows]))]
    s, e, island = block.s[rows], block.e[rows], block.island[rows]
    low = int(s.min()) if len(rows) else 0
    width = int(e.max()) - low + 1 if len(rows) else 1
    before = np.concatenate([[-1], np.maximum.accumulate(island * width + e - low)])[: len(rows)]
    columns = {"s": s, "e": e, "lab": codes[rows], "_gold": block.gold[rows]}
    return Block(pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns)), island * width + s - low >= before)


def by_version(gold: DataFrame, pred: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Counts and scores by version and category, and in total (TOTAL), of spans whose labels a taxonomy (version, lab, category) maps in several ways.

    Spans are shuffled once, and each island is aligned under all versions, one after the other; a
    task gives its counts by version and category. An outcome counts for each category that its gold
    or predicted span has. Labels that a version lacks are left out of it. The taxonomy has as many
    rows as there are labels in each version.
    """
    spans, _ = in_order(gold, pred)
    categories, labels = F.array_append(F.array_distinct(F.array_compact(F.array("gold_lab", "pred_lab"))), F.lit("TOTAL")), spans.schema["lab"].dataType
    known = taxonomy.where("lab is not null").select("version", F.col("lab").cast(labels).alias("lab"), "category").collect()
    versions = {v: {r["lab"]: r["category"] for r in known if r["version"] == v} for v in sorted({r["version"] for r in known})}
    kinds = np.array(["MCSN".find(x) for x, _ in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {v: sorted(set(of.values()), key=lambda c: (c is not None, c or "")) for v, of in versions.items()}
        sums = {v: np.zeros((len(names[v]) + 1, 4), np.int64) for v in versions}
        for block in blocks(batches):
            for v, of in versions.items():
                place = np.array([*(names[v].index(c) for c in of.values()), -1])
                known_as = pc.index_in(block.rows.column("lab"), pa.array(list(of), block.rows.column("lab").type))
                view = _in_version(block, place[pc.fill_null(known_as, len(of)).to_numpy()])
                kind, g, p = decided(view)
                code = view.rows.column("lab").to_numpy()
                one, other = (np.where(x < 0, -1, code[x]) if len(code) else x for x in (g, p))
                for lab, counted in ((one, one >= 0), (other, (other >= 0) & (other != one)), (np.full(len(kind), len(names[v])), np.ones(len(kind), bool))):
                    sums[v] += np.bincount(lab[counted] * 4 + kinds[kind[counted]], minlength=sums[v].size).reshape(-1, 4)
        rows = [(v, c, *n) for v in versions for c, n in zip([*names[v], "TOTAL"], sums[v].tolist(), strict=True) if c is not None and any(n)]
        yield pa.RecordBatch.from_pylist([dict(zip(("version", "category", *"mcsn"), r, strict=True)) for r in rows], schema=pa.schema([("version", pa.string()), ("category", pa.string()), *((x, pa.int64()) for x in "mcsn")]))

    mapped = lambda df: df.join(F.broadcast(taxonomy), "lab").select(F.struct("version", "doc_id").alias("doc_id"), "s", "e", F.col("category").alias("lab"))
    empty = hollow(mapped(gold), mapped(pred)).withColumn("version", F.col("doc_id.version")).withColumn("category", F.explode(categories)).groupBy("version", "category").agg(*counts())
    found = spans.mapInArrow(run, "version string, category string, m long, c long, s long, n long").unionByName(empty)
    return scored(found.groupBy("version", "category").agg(*(F.sum(x).alias(x) for x in "mcsn")))


def total_counts(outcomes: DataFrame) -> DataFrame:
    """One row: how many outcomes of each kind, 0 for none."""
    return outcomes.agg(*counts())


def by_category_directed(outcomes: DataFrame, digits: int = 6) -> DataFrame:
    """Counts by category (gold_cat, pred_cat) in which an outcome of two categories is wrong_gold in the one and wrong_pred in the other, with precision and recall of their own."""
    gold, pred, kind = F.col("gold_cat"), F.col("pred_cat"), F.col("match_type")
    one = lambda category, what: F.struct(category.alias("category"), what.alias("as"))
    own = one(F.coalesce(gold, pred), F.when(kind == "M", "exact").when(kind == "C", "boundary").when(kind == "S", "spurious").otherwise("missed"))
    # Each outcome is looked at once.
    each = F.when((kind != "C") | (gold == pred), F.array(own)).when((kind == "C") & (gold != pred), F.array(one(gold, F.lit("wrong_gold")), one(pred, F.lit("wrong_pred"))))
    rows = outcomes.select(F.explode(each).alias("_x")).select("_x.category", "_x.as")
    names = ("exact", "boundary", "wrong_gold", "wrong_pred", "spurious", "missed")
    found = rows.groupBy("category").agg(*(F.count_if(F.col("as") == x).alias(x) for x in names))
    e, b, wg, wp, s, n = (F.col(x) for x in names)
    p, r = ratio(e + 0.5 * (b + wp), e + b + wp + 0.25 * s), ratio(e + 0.5 * (b + wg), e + b + wg + n)
    return found.withColumns({"p": F.round(p, digits), "r": F.round(r, digits), "f1": F.round(f1(p, r), digits)})


def collapsed(per_label: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows of counts by label (lab, m, c, s, n) summed by category, scored anew."""
    sums = per_label.join(F.broadcast(categories), "lab").groupBy("category").agg(*(F.sum(x).alias(x) for x in "mcsn"))
    return scored(sums)


def complete_seeds(outcomes: DataFrame, folds: int) -> DataFrame:
    """Micro scores by seed with folds, and complete: whether all folds are there; where any seed is complete, those that aren't are left out."""
    found = scored(outcomes.groupBy("seed").agg(F.count_distinct("fold").alias("folds"), *counts())).withColumn("complete", F.col("folds") == folds)
    # As many rows as there are seeds.
    any_complete = F.max("complete").over(Window.partitionBy(F.lit(0)))
    return found.withColumn("_any", any_complete).where(F.col("complete") | ~F.col("_any")).drop("_any")


def with_micro(runs: DataFrame, per_seed: DataFrame, digits: int = 6) -> DataFrame:
    """summary() of fold and seed runs by fold, and one of the seeds' pooled scores as fold -1."""
    total = summary(per_seed.withColumn("fold", F.lit(-1)), ["fold"], digits)
    return summary(runs, ["fold"], digits).unionByName(total)


def over_folds(outcomes: DataFrame, digits: int = 4) -> DataFrame:
    """By label: folds, summed counts, and mean and deviation over folds of scores that were rounded first.

    Means are taken of whole numbers (scores times 10**digits), halves up, so that a tie is one in every engine.
    """
    each = scored(outcomes.groupBy("fold", F.coalesce("gold_lab", "pred_lab").alias("lab")).agg(*counts()), digits)
    scale, n = 10**digits, F.count(F.lit(1))

    def mean(c: Column) -> Column:
        whole = F.sum(F.round(c * scale).cast("long"))
        return F.floor((2 * whole + n) / (2 * n)) / scale

    spread = [f(F.col(x)) for x in ("strict_p", "strict_r", "strict_f1") for f in (mean, lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), digits))]
    names = [f"{x}_{y}" for x in ("p", "r", "f1") for y in ("mean", "sd")]
    return each.groupBy("lab").agg(F.count_distinct("fold").alias("folds"), *(F.sum(x).alias(x) for x in "mcsn"), *(c.alias(n) for c, n in zip(spread, names, strict=True)))


#: A prime below 2**31: products of two numbers below it add up within 64 bits.
PRIME = (1 << 31) - 1


def draw_bounds() -> list[int]:
    """How many hashes below PRIME stand for at most 0, 1, 2, ... draws of a unit, when it is drawn once on average."""
    shares = [exp(-1) / factorial(k) for k in range(13)]
    return [round(PRIME * sum(shares[: k + 1])) for k in range(13)]


def replicate_factors(replicates: int) -> list[tuple[int, int]]:
    """Two factors of each replicate: eight digits of an md5 each."""
    digits = [md5(f"replicate {r}".encode()).hexdigest() for r in range(replicates)]
    return [(int(d[:8], 16) % PRIME, int(d[8:16], 16) % PRIME) for d in digits]


def unit_hashes(unit: Column) -> tuple[Column, Column]:
    """Two hashes of a unit below PRIME: eight digits of its md5 each."""
    digits = F.md5(unit.cast("string").cast("binary"))
    return tuple(F.conv(F.substring(digits, at, 8), 16, 10).cast("long") % PRIME for at in (1, 9))


def draws(x: Column, y: Column, a: Column, b: Column) -> Column:
    """How often the unit of two hashes is drawn in the replicate of two factors."""
    mixed = (x * a + y * b) % PRIME
    return reduce(add, ((mixed >= bound).cast("int") for bound in draw_bounds()))


def bootstrap(outcomes: DataFrame, *, unit: str = "doc_id", replicates: int = 1000, least_units: int = 5, digits: int = 6) -> DataFrame:
    """One row: 2.5 and 97.5 percentiles of strict and adapted F1 over resampled units; nulls for fewer than least_units.

    In each replicate a unit is drawn so often as a hash of both says, once on
    average. Draws are worked out where a unit's counts lie and summed there: what is shuffled
    is a row of four sums for each replicate and task, however many units there are. A
    null unit counts as one.
    """
    units = outcomes.groupBy(unit).agg(*counts())
    factors = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in replicate_factors(replicates)))
    x, y = unit_hashes(F.coalesce(F.col(unit).cast("string"), F.lit("")))
    each = units.select(x.alias("_x"), y.alias("_y"), *"mcsn").select("*", F.posexplode(factors).alias("replicate", "_f"))
    drawn = each.withColumn("_times", draws(F.col("_x"), F.col("_y"), F.col("_f.a"), F.col("_f.b")))
    sums = drawn.groupBy("replicate").agg(*(F.sum(F.col(x) * F.col("_times")).alias(x) for x in "mcsn"), F.count(F.lit(1)).alias("_units"))
    bounds = [F.round(F.percentile(x, F.lit(q)), digits).alias(f"{x}_{name}") for x in ("strict_f1", "adapted_f1") for q, name in ((0.025, "low"), (0.975, "high"))]
    found = scored(sums, 12).agg(*bounds, F.max("_units").alias("_units"))
    return found.select(F.lit(replicates).cast("long").alias("replicates"), *(F.when(F.col("_units") >= least_units, F.col(b)).alias(b) for b in found.columns if b != "_units"))
