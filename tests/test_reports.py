"""Queries without SQL: what they say against a matching worked out document by document."""

from collections import Counter

import pytest

from glosswork.plans.catalog import QUERIES

SEEDS = (42, 123, 456, 789, 1011)


def pairs_of(gold, pred):
    """The size of a largest matching of spans that overlap and differ in label."""
    edges = [[j for j, p in enumerate(pred) if p[2] != g[2] and min(p[1], g[1]) > max(p[0], g[0])] for g in gold]
    owner = {}

    def place(i, seen):
        for j in edges[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(gold)))


@pytest.fixture(scope="module")
def counted(spark):
    """M, C, S, N of each document, wrong labels not corrected and corrected."""
    gold, pred, raw = {}, {}, {}
    for r in QUERIES["span_align_label"](spark, "/root/testdata/sf0.001").collect():
        raw.setdefault(r.doc_id, Counter())[r.match_type] += 1
        if r.match_type == "N":
            gold.setdefault(r.doc_id, []).append((r.gold_s, r.gold_e, r.gold_lab))
        if r.match_type == "S":
            pred.setdefault(r.doc_id, []).append((r.pred_s, r.pred_e, r.pred_lab))
    fixed = {}
    for doc_id, c in raw.items():
        n = pairs_of(gold.get(doc_id, []), pred.get(doc_id, []))
        fixed[doc_id] = c + Counter(C=n)
        fixed[doc_id].subtract(S=n, N=n)
    assert sum((f["C"] for f in fixed.values()), 0) > sum((c["C"] for c in raw.values()), 0)
    return raw, fixed


def total(counts, of=lambda doc_id: True):
    return tuple(sum(c[x] for d, c in counts.items() if of(d)) for x in "MCSN")


def scores(m, c, s, n):
    f1 = lambda p, r: 2 * p * r / (p + r)
    return f1(m / (m + c + s), m / (m + c + n)), f1((m + c / 2) / (m + c + s / 4), (m + c / 2) / (m + c + n))


def test_corrected_outcomes_and_their_reports(spark, sf_dir, counted):
    raw, fixed = counted
    run = lambda name: QUERIES[name](spark, sf_dir).collect()
    [row] = run("outcome_correct")
    assert tuple(row[x] for x in "mcsn") == total(fixed)
    assert len(run("wrong_label_matching")) == total(fixed)[1] - total(raw)[1]
    for row in run("report_output_format"):
        assert tuple(row[x] for x in "mcsn") == total(fixed, lambda d: d % 2 == row["run"])  # noqa: B023
    by_model = {r["model"]: r for r in run("report_model_performance")}
    assert tuple(by_model["labels"][x] for x in "mcsn") == total(raw) and tuple(by_model["labels, corrected"][x] for x in "mcsn") == total(fixed)
    found = {r["seed"]: (r["strict_f1"], r["adapted_f1"]) for r in run("report_seed_reproducibility")}
    want = {seed: scores(*total(fixed, lambda d: SEEDS[d // 10 % 5] == seed)) for seed in SEEDS}  # noqa: B023
    assert all(found[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
    assert found[-1] == pytest.approx(tuple(sum(v[i] for v in want.values()) / 5 for i in (0, 1)), abs=1e-5)


def test_long_reports(spark, sf_dir, counted):
    raw, fixed = counted
    rows = QUERIES["report_error_taxonomy"](spark, sf_dir).collect()
    for section, counts in (("raw", raw), ("corrected", fixed)):
        assert tuple(int(next(r.value for r in rows if (r.section, r.metric) == (section, x))) for x in "mcsn") == total(counts)
    wrong = [r.value for r in rows if r.section == "confusions"]
    assert len(wrong) == 8 and sum(wrong) <= total(fixed)[1] - total(raw)[1]
    assert all(r.name and r.value > 0 for r in rows if r.section == "terms")
    rows = QUERIES["report_directional"](spark, sf_dir).collect()
    assert all(r.value == 0 for r in rows if r.section == "reconcile")
    by = lambda metric: sum(r.value for r in rows if (r.section, r.metric) == ("category", metric))
    m, c, s, n = total(fixed)
    assert (by("exact"), by("spurious"), by("missed")) == (m, s, n) and by("wrong_gold") == by("wrong_pred") and by("boundary") + by("wrong_gold") == c


@pytest.fixture
def kept(monkeypatch):
    """The tables that a query writes on its way."""
    from glosswork.plans import score_queries

    found, plain = [], score_queries.stored

    def stored(df, name):
        found.append(plain(df, name))
        return found[-1]

    monkeypatch.setattr(score_queries, "stored", stored)
    return found


def test_wrong_labels_are_matched_where_spans_were_aligned(spark, sf_dir, kept):
    from glosswork.operators import alignment, matching
    from glosswork.plans.fixtures import gold, pred

    found = QUERIES["wrong_label_matching"](spark, sf_dir)
    assert not kept
    outcomes = alignment.align(gold(spark, sf_dir), pred(spark, sf_dir), two_tier=False)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, matching.wrong_labels(outcomes).collect()))
    whole = matching.align_corrected(gold(spark, sf_dir), pred(spark, sf_dir))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, matching.corrected(outcomes).collect()))


def test_error_taxonomy_keeps_rows_of_wrong_labels_alone(spark, sf_dir, kept):
    QUERIES["report_error_taxonomy"](spark, sf_dir)
    [table] = kept
    assert table.where("gold_s is not null and pred_s is not null and subtype <> 'wrong_label'").isEmpty()


@pytest.mark.parametrize("name", ["report_seed_reproducibility", "report_output_format"])
def test_scores_are_summed_without_a_table_of_outcomes(spark, sf_dir, kept, name):
    QUERIES[name](spark, sf_dir)
    assert not kept


def test_terms_are_taken_from_one_alignment(spark, sf_dir, kept):
    QUERIES["term_frequencies"](spark, sf_dir)
    [table] = kept
    assert [x.subtype for x in table.select("subtype").distinct().collect()] == ["class_confusion"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_are_picked_without_sorting_what_is_read(spark, sf_dir):
    plan = plan_of(QUERIES["display_layer_pick"](spark, sf_dir))
    exchange = next(i for i, x in enumerate(plan.splitlines()) if "Exchange hashpartitioning(doc_id" in x)
    assert not any("Sort [" in x or "Aggregate" in x for x in plan.splitlines()[exchange:]) and "HashAggregate" not in plan


def test_sentences_are_counted_in_one_pass(spark, sf_dir):
    plan = QUERIES["sentence_example_counts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # Texts are cut for the sentences that spans meet, and for those that are judged; spans across bounds are set out once.
    assert plan.count("Generate posexplode(") <= 3


def test_runs_are_checked_in_one_scan(spark, sf_dir):
    plan = QUERIES["scan_run_problems"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
