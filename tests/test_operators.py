"""Operators against brute force, and their defined results."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import agreement, alignment, anchoring, chunking, evaluation, labels, matching, spans, splits, tables
from glosswork.sources import files

SPANS = "doc_id long, s int, e int, lab string"


def random_spans(r, n, chain=False):
    out = []
    for _ in range(n):
        s = r.randrange(12 if chain else 60)
        out.append((s, s + r.randint(1, 6), r.choice("abc")))
    return out


def plain_alignment(gold, pred, two_tier):
    """One document's alignment by looking at every prediction for every gold span."""
    order = lambda x: (x[0], x[1], x[2])
    pred, used, out = sorted(pred, key=order), set(), []
    for g in sorted(gold, key=order):
        best = None
        for j, p in enumerate(pred):
            overlap = min(p[1], g[1]) - max(p[0], g[0])
            if j in used or overlap <= 0:
                continue
            tier = 3 if p == g else 2 if p[2] == g[2] else int(two_tier)
            if tier and (best is None or (tier, overlap) > best[:2]):
                best = (tier, overlap, j)
        if best:
            used.add(best[2])
        out.append((*alignment.KINDS[best[0] if best else 0], *g, *(pred[best[2]] if best else (None,) * 3)))
    return sorted([*out, *(("S", "spurious", None, None, None, *p) for j, p in enumerate(pred) if j not in used)], key=str)


def found_by_doc(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    return {k: sorted(v, key=str) for k, v in out.items()}


@pytest.mark.parametrize("folded", [0, 48])
def test_alignment_equals_brute_force(spark, folded):
    r = random.Random(4)
    docs = {i: (random_spans(r, r.randint(0, 9), i % 2), random_spans(r, r.randint(0, 9), i % 2)) for i in range(60)}
    side = lambda k: spark.createDataFrame([(i, *x) for i, d in docs.items() for x in d[k]], SPANS)
    for two_tier in (True, False):
        got = found_by_doc(alignment.align(side(0), side(1), two_tier=two_tier, folded=folded))
        assert got == {i: plain_alignment(*d, two_tier) for i, d in docs.items() if d[0] or d[1]}


def test_alignment_of_a_long_chain_of_spans(spark):
    rows = [(1, 2 * i, 2 * i + 3, "a") for i in range(5000)]
    gold, pred = spark.createDataFrame(rows, SPANS), spark.createDataFrame([(d, s + i % 2, e, lab) for i, (d, s, e, lab) in enumerate(rows)], SPANS)
    began = time.time()
    counts = {r["match_type"]: r["n"] for r in alignment.align(gold, pred).groupBy("match_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["M"] == 2500 and counts["M"] + counts["C"] + counts.get("N", 0) == 5000
    assert time.time() - began < 60


def test_alignment_of_nulls_hollow_and_repeated_spans(spark):
    gold = spark.createDataFrame([(1, 0, 5, None), (1, 9, 9, "a"), (2, None, 4, "a"), (None, 0, 5, "a"), (3, 0, 5, "a"), (3, 0, 5, "a")], SPANS)
    pred = spark.createDataFrame([(1, 0, 5, None), (1, 7, 6, "b"), (None, 0, 5, "a"), (3, 0, 5, "a")], SPANS)
    got = sorted((r["doc_id"], r["match_type"], r["subtype"]) for r in alignment.align(gold.withColumn("extra", F.lit(1)), pred).collect())
    assert got == [(1, "M", "exact"), (1, "N", "missed"), (1, "S", "spurious"), (2, "N", "missed"), (3, "M", "exact"), (3, "N", "missed")]
    assert alignment.align(gold.limit(0), pred.limit(0)).count() == 0


def test_legacy_scorer_equals_brute_force(spark):
    r = random.Random(6)
    docs = {i: (set(random_spans(r, r.randint(1, 7), True)), set(random_spans(r, r.randint(1, 7), True))) for i in range(50)}
    side = lambda k: spark.createDataFrame([(i, *x) for i, d in docs.items() for x in d[k]], SPANS)
    got = found_by_doc(alignment.align_legacy(side(0), side(1)))
    for i, (gold, pred) in docs.items():
        pred, flags, m, c, n = sorted(pred), {}, 0, 0, 0
        for g in sorted(gold):
            for p in pred:
                if p == g:
                    m, flags[p] = m + 1, 1
                    break
                if min(p[1], g[1]) > max(p[0], g[0]) and p not in flags:
                    c, flags[p] = c + 1, 1
                    break
            else:
                n += 1
        kinds = [x[0] for x in got[i]]
        assert (kinds.count("M"), kinds.count("C"), kinds.count("N"), kinds.count("S")) == (m, c, n, max(0, len(pred) - m - c)), i


def most_pairs(gold, pred):
    edges = [[j for j, p in enumerate(pred) if p[2] != g[2] and min(p[1], g[1]) > max(p[0], g[0])] for g in gold]

    def best(i, used):
        if i == len(edges):
            return 0
        return max([best(i + 1, used), *(1 + best(i + 1, used | {j}) for j in edges[i] if j not in used)])

    return best(0, frozenset())


def test_wrong_labels_are_a_largest_matching(spark):
    r = random.Random(8)
    docs = {i: (random_spans(r, r.randint(0, 6), True), random_spans(r, r.randint(0, 6), True)) for i in range(60)}
    rows = [(i, "N", "missed", *g, None, None, None) for i, d in docs.items() for g in d[0]] + [(i, "S", "spurious", None, None, None, *p) for i, d in docs.items() for p in d[1]]
    rows += [(1, "M", "exact", 0, 1, "a", 0, 1, "a"), (2, "N", "missed", 0, 5, None, None, None, None), (2, "N", "missed", 4, 4, "a", None, None, None)]
    outcomes = spark.createDataFrame(rows, "doc_id long, match_type string, subtype string, gold_s int, gold_e int, gold_lab string, pred_s int, pred_e int, pred_lab string")
    got = found_by_doc(matching.corrected(outcomes))
    for i, (gold, pred) in docs.items():
        pairs = [x for x in got.get(i, []) if x[1] == "wrong_label"]
        assert len(pairs) == most_pairs(gold, pred), i
        assert all(x[4] != x[7] and min(x[3], x[6]) > max(x[2], x[5]) for x in pairs)
        rest = [x for x in got.get(i, []) if x[1] != "wrong_label"]
        own = sorted([x[2:5] for x in pairs + [y for y in rest if y[0] == "N"]], key=str)
        extra = [(0, 5, None), (4, 4, "a")] if i == 2 else []
        assert own == sorted([*gold, *extra], key=str), i
    assert matching.corrected(outcomes.limit(0)).count() == 0


def test_dedupe_by_margin_equals_brute_force(spark):
    r = random.Random(9)
    docs = {i: [(*x, r.randrange(9)) for x in random_spans(r, r.randint(1, 8), True)] for i in range(50)}
    df = spark.createDataFrame([(i, *x) for i, d in docs.items() for x in d], f"{SPANS}, margin int")
    got = found_by_doc(chunking.dedupe_margin(df))
    for i, rows in docs.items():
        kept = []
        for x in sorted(rows, key=lambda x: (x[0], x[1], -x[3])):
            k = next((k for k, y in enumerate(kept) if y[2] == x[2] and x[0] < y[1] and y[0] < x[1]), None)
            if k is None:
                kept.append(x)
            elif x[3] > kept[k][3]:
                kept[k] = x
        assert got[i] == sorted(kept, key=str), i


def test_tags_that_nest_cross_and_stay_open(spark):
    labels_of = {"AE": "ADVERSE", "LAB": "TEST"}
    texts = ["a <AE>b</AE> c", "<ae>x<LAB>y</ae>z</LAB>", "<AE></AE>", "</LAB>q", "<AE>open", "no < AE tag", None, ""]
    rows = {r["doc_id"]: r for r in anchoring.parsed_tags(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels_of).collect()}
    assert rows[0]["clean"] == "a b c" and [tuple(x) for x in rows[0]["spans"]] == [(2, 3, "ADVERSE")] and not rows[0]["warnings"]
    assert [tuple(x) for x in rows[1]["spans"]] == [(0, 2, "ADVERSE"), (1, 3, "TEST")] and len(rows[1]["warnings"]) == 2
    assert not rows[2]["spans"] and rows[2]["warnings"] and rows[3]["warnings"] and rows[4]["warnings"]
    assert rows[5]["clean"] == "no < AE tag" and rows[6]["clean"] == rows[7]["clean"] == ""


def test_surfaces_and_claims_are_anchored(spark):
    texts = spark.createDataFrame([(1, "aa b aa b"), (2, "nothing"), (3, None)], "doc_id long, text string")
    mentions = spark.createDataFrame([(1, i, "x", "aa") for i in range(3)] + [(2, 0, "x", "aa"), (3, 0, "x", "aa"), (1, 5, "x", "")], "doc_id long, place int, lab string, surface string")
    got = sorted(((r["doc_id"], r["place"], r["s"]) for r in anchoring.anchored_surfaces(mentions, texts).collect()), key=str)
    assert got == sorted([(1, 0, 0), (1, 1, 5), (1, 2, None), (1, 5, None), (2, 0, None), (3, 0, None)], key=str)
    claims = spark.createDataFrame([(1, "x", 0, "aa"), (1, "x", 4, "aa"), (1, "x", 5, "aa"), (1, "x", 1, "zz"), (1, "x", None, "aa"), (2, "x", -3, "not")], "doc_id long, lab string, s int, surface string")
    assert sorted((r["doc_id"], r["s"], r["e"]) for r in anchoring.anchored_offsets(claims, texts).collect()) == [(1, 0, 2), (1, 5, 7), (2, 0, 3)]
    long = spark.createDataFrame([(1, "we saw a severe headache after the dose")], "doc_id long, text string")
    found = anchoring.fuzzy_anchored(spark.createDataFrame([(1, "severe headachx"), (1, "broken leg of a table")], "doc_id long, surface string"), long).collect()
    assert {r["surface"]: (r["s"] is not None and abs(r["s"] - 9) <= 2) for r in found} == {"severe headachx": True, "broken leg of a table": False}


def test_tokens_equal_pythons_rule(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text", T.n_tokens(F.col("text")).alias("n"), T.n_sentences(F.col("text")).alias("k")).collect()
    assert all(r["n"] == len(re.findall(r"\w+|[^\w\s]", r["text"])) for r in rows)
    assert all(r["k"] == sum(bool(x.strip()) for x in re.split(r"[↵\n]+|(?<=[.!?])\s+", r["text"])) for r in rows)


def test_chunks_cover_the_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = chunking.sliding_chunks(docs, size=200, overlap=40).collect()
    assert all(r["text"] == texts[r["doc_id"]][r["s"] : r["e"]] and r["e"] - r["s"] <= 200 for r in rows)
    covered = {}
    for r in rows:
        covered.setdefault(r["doc_id"], set()).update(range(r["s"], r["e"]))
    assert all(not t[i].strip() for d, t in texts.items() for i in range(len(t)) if i not in covered.get(d, ()))
    with pytest.raises(ValueError):
        chunking.sliding_chunks(docs, size=100, overlap=60)


def test_clean_span_moves_past_white_space(spark):
    text = "  \t ab c \n"
    for s, e in itertools.product(range(-2, 12), repeat=2):
        a, b = spans.clean_span(F.lit(text), F.lit(s), F.lit(e))
        row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
        low = min(max(s, 0), len(text))
        part = text[low : max(min(e, len(text)), low)]
        assert text[row["a"] : row["b"]] == part.strip()


def test_labels_excluded_unknown_and_null(spark):
    taxonomy = spark.createDataFrame([("AE", "AE", "AE"), ("ae", "AE2", "AE"), ("RO", None, None)], "raw string, canonical string, category string")
    rows = [(1, " AE ", "3", "5"), (1, "ae", "x", "5"), (1, "aE", "-1", "5"), (1, "ro", "1", "2"), (1, "zz", "1", "2"), (1, None, "1", "2"), (1, "AE", "5", "5"), (1, "AE", "5", "99"), (1, "AE", None, "9")]
    df = spark.createDataFrame(rows, "doc_id long, label string, s string, e string")
    got = sorted(((r["label"], r["canonical"], r["status"]) for r in labels.normalized(df, taxonomy).collect()), key=str)
    assert ("ae", "AE2", "mapped") in got and ("ro", None, "excluded") in got and ("zz", None, "unknown") in got and (None, None, "unknown") in got and len(got) == len(rows)
    reasons = sorted(r["reason"] for r in labels.with_offsets(df, F.lit(20)).collect())
    assert reasons == ["beyond", "empty", "negative", "no number", "no number", "valid", "valid", "valid", "valid"]


def test_edit_log_with_undo_and_removal(spark):
    log = [(1, 1, "add", None, "a"), (1, 2, "update", None, "b"), (1, 3, "undo", 2, None), (2, 4, "add", None, "c"), (2, 5, "remove", None, None), (3, 6, "add", None, "d"), (3, 7, "remove", None, None), (3, 8, "undo", 7, None), (3, 9, "dispute", None, None), (4, 10, "update", None, "x"), (4, 11, "remove", None, None), (4, 12, "add", None, "y")]
    df = spark.createDataFrame(log, "k long, id long, action string, undoes long, value string")
    assert sorted(tuple(r) for r in tables.replayed(df, "k", "id").collect()) == [(1, "a", False), (3, "d", True), (4, "y", False)]
    assert tables.replayed(df.limit(0), "k", "id").count() == 0


def test_checked_results_and_bootstrap(spark):
    good = spark.createDataFrame([(i, k) for i in range(20) for k in "MMCSN"], "doc_id long, match_type string")
    with pytest.raises(ValueError):
        files.checked(good)
    with pytest.raises(Exception, match="match_type is none of"):
        files.checked(spark.createDataFrame([("X",)], "match_type string"), ("match_type",)).collect()
    row = evaluation.bootstrap(good, replicates=50).first()
    assert row["replicates"] == 50 and abs(row["strict_f1_low"] - 0.5) < 1e-6 and abs(row["strict_f1_high"] - 0.5) < 1e-6
    uneven = spark.createDataFrame([(i, "M" if i % 3 else "S") for i in range(60)], "doc_id long, match_type string")
    row = evaluation.bootstrap(uneven, replicates=100).first()
    assert row["strict_f1_low"] < 0.8 < row["strict_f1_high"]
    assert evaluation.bootstrap(good.where("doc_id < 3"), replicates=10).first()["strict_f1_low"] is None


def test_bootstrap_draws_as_resampling_does(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    units = rng.poisson([6, 2, 1, 2], (3000, 4))
    rows = [(i, kind) for i, counts in enumerate(units.tolist()) for kind, n in zip("MCSN", counts, strict=True) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, match_type string")
    found = evaluation.bootstrap(df, replicates=1000)
    # Nothing but the counts by unit and four sums a replicate is shuffled, and nothing is joined.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2 and "Range (" not in plan
    times = rng.multinomial(len(units), np.full(len(units), 1 / len(units)), 4000)
    m, c, s, n = (times @ units).T.astype(float)
    f1 = lambda top, p, r: 2 * (top / p) * (top / r) / (top / p + top / r)
    row = found.first()
    for name, f in (("strict_f1", f1(m, m + c + s, m + c + n)), ("adapted_f1", f1(m + c / 2, m + c + s / 4, m + c + n))):
        low, high = np.percentile(f, [2.5, 97.5])
        assert abs(row[f"{name}_low"] - low) < 0.005 and abs(row[f"{name}_high"] - high) < 0.005 and row[f"{name}_high"] - row[f"{name}_low"] > 0.6 * (high - low)
    drawn = spark.range(20_000).select(evaluation.draws(*evaluation.unit_hashes(F.col("id")), F.lit(48_271), F.lit(1_234_567)).alias("k")).groupBy("k").count()
    share = {r["k"]: r["count"] / 20_000 for r in drawn.collect()}
    assert abs(share[0] - 0.3679) < 0.015 and abs(share[1] - 0.3679) < 0.015 and abs(share[2] - 0.1839) < 0.012


def test_splits_cover_each_row_once(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)] + [(7, 1)], "k long, series int")
    parts = [r["part"] for r in splits.fractions(df, "k", test=10, dev=20).collect()]
    assert (parts.count("test"), parts.count("dev"), len(parts)) == (5, 10, 51)
    held = splits.leave_one_out(df, "k", "series", [0, 1, 2], dev=10).collect()
    assert len(held) == 3 * 51 and all((r["part"] == "test") == (r["series"] == r["held"]) for r in held)
    assert splits.fractions(df.limit(0), "k", test=10, dev=10).count() == 0


def test_agreement_without_pairs_and_with_one_side(spark):
    df = spark.createDataFrame([(1, "a", None, "x", None, "ONE"), (1, "a", "a", "x.", "x", "Both"), (2, "a", "b", "x", "x", None)], "case_id long, label_1 string, label_2 string, text_1 string, text_2 string, truth string")
    assert sorted((r["kind"], r["n"]) for r in agreement.discrepancies(df).collect()) == [("punctuation", 1), ("unilateral", 1), ("wrong label", 1)]
    row = agreement.summarised(df.limit(0)).first()
    assert row["pairs"] == 0 and row["strict_f1"] == 0


def brute_window(needle, text):
    """The most similar window by looking at all of them."""
    from difflib import SequenceMatcher

    best, low = None, max(1, int(len(needle) * 0.7))
    for s in range(len(text)):
        for width in (low, len(needle), min(len(text), max(low, int(len(needle) * 1.3)))):
            e = min(len(text), s + width)
            ratio = SequenceMatcher(None, needle, text[s:e], autojunk=False).ratio()
            best = (s, e, ratio) if best is None or ratio > best[2] else best
        if best[2] >= 0.98:
            break
    return best if best and best[2] >= 0.8 else None


def test_fuzzy_places_equal_brute_force_on_two_thousand_surfaces():
    from glosswork.operators.fuzzy import TextIndex, similar_window

    r, found, none = random.Random(6), 0, 0
    for _ in range(100):
        text = "".join(r.choice(["ab", "ba", "c", "d ", "e", "é", "😀", "the "][: r.randint(2, 8)]) for _ in range(r.randint(0, 60)))
        index = TextIndex(text)
        for _ in range(20):
            at, n = r.randrange(len(text) + 1), r.choice([1, 2, 3, 5, 9, 14, 25])
            chars = list(text[at : at + n])
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                where = r.randrange(len(chars) + 1)
                chars[where : where + r.choice([0, 1])] = r.choice(["", "x", "a", "#b"])
            surface = "".join(chars)
            want = brute_window(surface, text) if surface and text else None
            assert similar_window(index, surface) == want, (surface, text)
            found, none = found + (want is not None), none + (want is None)
    assert found > 800 and none > 300


def test_fuzzy_search_of_a_long_text_is_fast():
    from glosswork.operators.fuzzy import TextIndex, similar_window

    r = random.Random(2)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(180_000))
    assert len(text) > 1_000_000
    began, index = time.time(), TextIndex(text)
    for at in (400_000, 900_000):
        surface = text[at : at + 12] + "#" + text[at + 13 : at + 30]
        s, e, ratio = similar_window(index, surface)
        assert (s, e) == (at, at + 30) and ratio > 0.9
    assert time.time() - began < 20


def test_mentions_beyond_the_last_occurrence(spark):
    texts = spark.createDataFrame([(1, "ab ab ab"), (2, "no"), (3, None)], "doc_id long, text string")
    rows = [(1, i, lab, "ab") for i, lab in enumerate("AAABABBBB")] + [(1, 20, "A", "zz"), (1, 21, "A", ""), (2, 0, None, "no"), (2, 1, None, "no"), (3, 0, "A", "x"), (9, 0, "A", "x")]
    got = {(x.doc_id, x.place): x.s for x in anchoring.anchored_surfaces(spark.createDataFrame(rows, "doc_id long, place int, lab string, surface string"), texts).collect()}
    # A has all three; B begins anew, goes on from where it is, and has all three in the end.
    assert [got[1, i] for i in range(9)] == [0, 3, 6, 0, None, 3, 6, None, None]
    assert [got[k] for k in ((1, 20), (1, 21), (2, 0), (2, 1), (3, 0), (9, 0))] == [None, None, 0, None, None, None]

    def plain(places, labels):
        used, before, out = set(), -1, []
        for lab in labels:
            free = [s for s in places if (s, lab) not in used]
            s = next((x for x in free if x > before), free[0] if free else None)
            out.append(s)
            if s is not None:
                before = s
                used.add((s, lab))
        return out

    r = random.Random(3)
    for _ in range(300):
        places, labels = sorted(r.sample(range(50), r.randint(0, 6))), [r.choice("ABC") for _ in range(r.randint(0, 15))]
        assert anchoring.occupied(places, labels) == plain(places, labels)


def test_surfaces_are_exact_fuzzy_or_unmapped(spark):
    texts = spark.createDataFrame([(1, "a severe headache and a fever")], "doc_id long, text string")
    rows = [(1, 0, "A", "fever"), (1, 1, "A", "severe headachx"), (1, 2, "A", "broken leg"), (1, 3, "A", " severe "), (1, 4, "A", None), (2, 0, "A", "x")]
    got = sorted((x.doc_id, x.place, x.s, x.e, x.how) for x in anchoring.anchored_entities(spark.createDataFrame(rows, "doc_id long, place int, lab string, surface string"), texts).collect())
    assert got == [(1, 0, 24, 29, "exact"), (1, 1, 2, 16, "fuzzy"), (1, 2, None, None, "unmapped"), (1, 3, 2, 8, "exact"), (1, 4, None, None, "unmapped"), (2, 0, None, None, "unmapped")]


def test_tags_of_changed_texts_are_anchored(spark):
    from glosswork.operators.drift import boundaries, equal_stretches, increasing

    r = random.Random(8)
    for _ in range(200):
        values = [r.randrange(30) for _ in range(r.randint(0, 12))]
        longest = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(set(c))), default=0) if len(values) < 9 else None
        run = [values[i] for i in increasing(values)]
        assert run == sorted(set(run)) and longest in (None, len(run))
    sentences = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(9)) + "." for _ in range(40)]
    text = " ".join(sentences)
    changed = " ".join("An opening. " + s if i == 3 else s.upper()[:20] + s[20:] if i == 9 else s for i, s in enumerate(sentences) if i != 20)
    to = boundaries(changed, text)
    assert len(to) == len(changed) + 1 and (to[1:] >= to[:-1]).all() and to[-1] == len(text)
    for i, s in enumerate(sentences):
        if i not in (3, 9, 20):
            at = changed.index(s)
            assert to[at + 8] == text.index(s) + 8, i
    stretches = equal_stretches(changed, text)
    assert all(changed[i : i + n] == text[j : j + n] for i, j, n in stretches) and all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in itertools.pairwise(stretches))

    def tagged(s, word):
        return s.replace(word, f"<AE>{word}</AE>", 1)

    word = sentences[30].split()[4]
    rows = [(1, tagged(changed, word)), (2, tagged(text, word)), (3, "<AE>nothing of it</AE>"), (4, "<AE>x</AE>"), (5, "no tags"), (6, None), (7, f"<AE>{word}</AE> and <AE>{word}</AE> again")]
    texts = spark.createDataFrame([(1, text), (2, text), (3, "another text"), (4, ""), (5, text), (6, text), (7, f"{word} and  {word} again")], "doc_id long, text string")
    got = sorted(map(tuple, anchoring.anchored_tags(spark.createDataFrame(rows, "doc_id long, text string"), texts, {"AE": "A"}).select("doc_id", "s", "e", "how").collect()))
    at = text.index(word)
    assert got[:2] == [(1, at, at + 6, "refined"), (2, at, at + 6, "same")] and got[2][0] == 3 and got[2][3] == "near"
    assert [g[:3] for g in got[3:]] == [(7, 0, 6), (7, 12, 18)]
    began = time.time()
    boundaries("x " + text * 40, text * 40)
    assert time.time() - began < 10
