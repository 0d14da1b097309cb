"""Queries of scores, matching, agreement, splits and reports over the derived spans."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import agreement, alignment, evaluation, matching, splits, tables
from ..sources import files
from ..sources.folders import new_folder
from .fixtures import CATEGORY_SQL, COUNTS_SQL, SQL, base, categories, gold, outcomes_sql, pred, scores_sql, table
from .queries import _RUNS, outcomes, runs
from .registry import ORACLE_SQL, query

_O = f"with recursive {outcomes_sql(True)}"
_COUNTS = f"x as (select {COUNTS_SQL} from outcomes)"


def count_n():
    return F.count(F.lit(1)).alias("n")


@query(f"{_O}, {_COUNTS} select * from x")
def mcsn_counts(spark, sf_dir):
    return evaluation.total_counts(outcomes(spark, sf_dir))


def stored(df, name):
    """df written once and read again: what costs a matching is used several times."""
    out = new_folder(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def label_outcomes(spark, sf_dir):
    """Outcomes by labels alone, aligned once."""
    return stored(outcomes(spark, sf_dir, two_tier=False), "outcomes")


def corrected_counts(spark, sf_dir):
    """doc_id, m, c, s, n of documents, or parts of them, once wrong labels are corrected."""
    return matching.counts_by_document(gold(spark, sf_dir), pred(spark, sf_dir), ("corrected",)).toDF("doc_id", *"mcsn")


def _counts_by(counts, *keys):
    """counts (m, c, s, n) summed up."""
    return counts.groupBy(*keys).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "mcsn"))


def run_outcomes(spark, sf_dir):
    """Kinds of the outcomes of runs, aligned once."""
    return stored(runs(spark, sf_dir).select("fold", "seed", "doc_id", "match_type"), "runs")


def _some(kind: str):
    return ["m", "c", "s", "n", *(f"{kind}_{x}" for x in ("p", "r", "f1"))]


@query(f"{_O}, {_COUNTS}, y as (select *, {scores_sql()} from x) select {', '.join(_some('strict'))} from y")
def prf_strict(spark, sf_dir):
    return evaluation.scored(mcsn_counts(spark, sf_dir)).select(*_some("strict"))


@query(f"{_O}, {_COUNTS}, y as (select *, {scores_sql()} from x) select {', '.join(_some('adapted'))} from y")
def prf_adapted(spark, sf_dir):
    return evaluation.scored(mcsn_counts(spark, sf_dir)).select(*_some("adapted"))


@query(f"{_O}, {_COUNTS} select m, c, s, n, round(m / (m + s), 6) exact_p, round(m / (m + n), 6) exact_r, round(2 * (m / (m + s)) * (m / (m + n)) / (m / (m + s) + m / (m + n)), 6) exact_f1 from x")
def prf_ablation(spark, sf_dir):
    return evaluation.scored_exact(mcsn_counts(spark, sf_dir))


@query(f"{_RUNS}, x as (select seed, {COUNTS_SQL} from runs group by 1), y as (select seed, {scores_sql()} from x) select count(*) runs, round(avg(strict_f1), 6) strict_f1_mean, round(coalesce(stddev_samp(strict_f1), 0), 6) strict_f1_sd, round(avg(adapted_f1), 6) adapted_f1_mean, round(coalesce(stddev_samp(adapted_f1), 0), 6) adapted_f1_sd from y")
def seed_summary(spark, sf_dir):
    return evaluation.summary(evaluation.pooled(runs(spark, sf_dir), ["seed"]), [])


@query(f"""{_RUNS}, x as (select seed, count(distinct fold) folds, {COUNTS_SQL} from runs where not (seed = 42 and fold = 3) group by 1), y as (select *, folds = (select count(distinct fold) from runs) complete from x) select *, {scores_sql()} from y where complete or not (select bool_or(complete) from y)""")
def pool_by_seed_complete(spark, sf_dir):
    """Seeds that lack a fold are left out where others are complete."""
    found = run_outcomes(spark, sf_dir)
    return evaluation.complete_seeds(found.where("not (seed = 42 and fold = 3)"), found.select("fold").distinct().count())


_F1S = "round(avg(strict_f1), 6) strict_f1_mean, round(coalesce(stddev_samp(strict_f1), 0), 6) strict_f1_sd, round(avg(adapted_f1), 6) adapted_f1_mean, round(coalesce(stddev_samp(adapted_f1), 0), 6) adapted_f1_sd"


@query(f"""{_RUNS}, x as (select fold, seed, {COUNTS_SQL} from runs group by 1, 2), y as (select fold, {scores_sql()} from x), z as (select seed, {COUNTS_SQL} from runs group by 1), w as (select {scores_sql()} from z),
    v as (select fold, count(*) runs, {_F1S} from y group by fold union all select -1, count(*), {_F1S} from w), k as (select fold, count(distinct doc_id) documents from runs group by 1 union all select -1, count(distinct doc_id) from runs) select v.*, documents from v join k using (fold)""")
def report_case_series(spark, sf_dir):
    """Each fold's scores over seeds and the micro total (fold -1), with the sizes of their cohorts."""
    found = run_outcomes(spark, sf_dir)
    scores = evaluation.with_micro(evaluation.pooled(found, ["fold", "seed"]), evaluation.pooled(found, ["seed"]))
    # A document is in one fold: their sizes add up. Either side has a row for each fold.
    each = found.groupBy("fold", "doc_id").agg(F.lit(1).alias("_one")).groupBy("fold").agg(F.count(F.lit(1)).alias("documents"))
    return scores.join(each.unionByName(each.agg(F.lit(-1).alias("fold"), F.sum("documents").alias("documents"))), "fold")


@query(f"""{_O}, {CATEGORY_SQL}, u as (select match_type, a.category g, b.category p from outcomes left join categories a on a.lab = gold_lab left join categories b on b.lab = pred_lab),
    r as (select coalesce(g, p) category, case match_type when 'M' then 'exact' when 'C' then 'boundary' when 'S' then 'spurious' else 'missed' end k from u where match_type <> 'C' or g = p union all select g, 'wrong_gold' from u where match_type = 'C' and g <> p union all select p, 'wrong_pred' from u where match_type = 'C' and g <> p),
    x as (select category, {', '.join(f"count(*) filter (where k = '{k}') {k}" for k in ('exact', 'boundary', 'wrong_gold', 'wrong_pred', 'spurious', 'missed'))} from r group by 1),
    y as (select *, (exact + 0.5 * (boundary + wrong_pred))::double / (exact + boundary + wrong_pred + 0.25 * spurious)::double pp, (exact + 0.5 * (boundary + wrong_gold))::double / (exact + boundary + wrong_gold + missed)::double rr from x)
    select * exclude (pp, rr), round(pp, 6) p, round(rr, 6) r, round(2 * pp * rr / (pp + rr), 6) f1 from y""")
def per_category_metrics_directional(spark, sf_dir):
    return evaluation.by_category_directed(with_categories(spark, outcomes(spark, sf_dir)))


def with_categories(spark, found):
    for side in ("gold", "pred"):
        found = found.join(F.broadcast(categories(spark).select(F.col("lab").alias(f"{side}_lab"), F.col("category").alias(f"{side}_cat"))), f"{side}_lab", "left")
    return found


@query(f"""{_O}, {CATEGORY_SQL}, l as (select coalesce(gold_lab, pred_lab) lab, {COUNTS_SQL} from outcomes group by 1), x as (select category, sum(m)::bigint m, sum(c)::bigint c, sum(s)::bigint s, sum(n)::bigint n from l join categories using (lab) group by 1) select *, {scores_sql()} from x""")
def collapsed_category(spark, sf_dir):
    per_label = evaluation.by_label(outcomes(spark, sf_dir)).select("lab", *"mcsn")
    return evaluation.collapsed(per_label, categories(spark))


@query(f"""{_RUNS}, x as (select fold, coalesce(gold_lab, pred_lab) lab, {COUNTS_SQL} from runs group by 1, 2), y as (select *, {scores_sql(4)} from x)
    select lab, count(distinct fold) folds, sum(m)::bigint m, sum(c)::bigint c, sum(s)::bigint s, sum(n)::bigint n, {', '.join(f'((2 * sum(cast(round(strict_{k} * 10000) as bigint)) + count(*)) // (2 * count(*))) / 10000 {k}_mean, round(coalesce(stddev_samp(strict_{k}), 0), 4) {k}_sd' for k in ('p', 'r', 'f1'))} from y group by lab""")
def label_summary_over_folds(spark, sf_dir):
    return evaluation.over_folds(runs(spark, sf_dir))


@query(f"{_RUNS}, {CATEGORY_SQL} select fold, category, count(distinct seed) runs, count(*) n from runs join categories on lab = coalesce(gold_lab, pred_lab) group by all")
def loo_run_summary(spark, sf_dir):
    found = runs(spark, sf_dir).withColumn("lab", F.coalesce("gold_lab", "pred_lab")).join(F.broadcast(categories(spark)), "lab")
    return found.groupBy("fold", "category").agg(F.count_distinct("seed").alias("runs"), count_n())


@query(f"""{_RUNS}, x as (select doc_id % 3 model, seed, {COUNTS_SQL} from runs group by 1, 2), y as (select model, m / (m + s) p, m / (m + n) r from x), z as (select model, 2 * p * r / (p + r) f from y)
    select model, count(*) runs, printf('%.4f ± %.4f', avg(f), coalesce(stddev_samp(f), 0)) f1 from z group by model""")
def model_ablation_summary(spark, sf_dir):
    from ..functions.text import percent_text

    each = runs(spark, sf_dir).withColumn("model", F.col("doc_id") % 3).groupBy("model", "seed").agg(*evaluation.counts())
    found = each.withColumn("f", scores.exact_only(*(F.col(x) for x in "mcsn"))[2])
    return found.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), percent_text(F.avg("f"), F.coalesce(F.stddev_samp("f"), F.lit(0.0))).alias("f1"))


@query("""select user_id, arg_max(event_id, struct_pack(v := "value", l := -event_id)) best, max("value") best_value, max(event_id) last, arg_max("value", event_id) last_value, count(*) points from events where "value" is not null group by user_id""")
def best_checkpoint(spark, sf_dir):
    """Of each log the first row of the largest score, the last row and the number of rows."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.max("value").alias("best_value"), F.max("event_id").alias("last"), F.max_by("value", "event_id").alias("last_value"), F.count(F.lit(1)).alias("points"))


@query(f"{_O} select doc_id, count(gold_s) gold, count(pred_s) pred, {COUNTS_SQL} from outcomes group by doc_id")
def doc_summary(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("doc_id").agg(F.count("gold_s").alias("gold"), F.count("pred_s").alias("pred"), *evaluation.counts())


@query(f"{_O} select pred_lab lab, count(*) n from outcomes where match_type in ('M', 'C', 'S') and pred_lab is not null group by 1")
def prediction_label_counts(spark, sf_dir):
    return outcomes(spark, sf_dir).where("match_type in ('M', 'C', 'S') and pred_lab is not null").groupBy(F.col("pred_lab").alias("lab")).agg(count_n())


_TERMS = r"""t as (select trim(regexp_replace(lower(substring(d.text, gold_s + 1, gold_e - gold_s)), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g')) term from outcomes join c using (gold_lab, pred_lab) join documents d on d.doc_id = outcomes.doc_id where subtype = 'class_confusion')"""


@query(f"{_O}, c as (select gold_lab, pred_lab from outcomes where subtype = 'class_confusion' group by all order by count(*) desc, gold_lab, pred_lab limit 8), {_TERMS} select term, count(*) n from t where term <> '' group by 1")
def term_frequencies(spark, sf_dir):
    """What the texts hold where gold spans were given a wrong label, of the most frequent pairs of labels."""
    confused = stored(alignment.align_only(gold(spark, sf_dir), pred(spark, sf_dir), alignment.CONFUSED), "confused")
    return _terms(spark, sf_dir, confused)


def _terms(spark, sf_dir, found, kind="class_confusion"):
    wrong = found.where(F.col("subtype") == kind)
    pairs = wrong.groupBy("gold_lab", "pred_lab").agg(count_n()).orderBy(F.desc("n"), "gold_lab", "pred_lab").limit(8)
    return evaluation.term_frequencies(wrong, pairs, table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"with {SQL} select (select count(*) from gold) gold, (select count(*) from pred) pred, true conserved, true paired")
def dq_conservation(spark, sf_dir):
    """Once wrong labels are corrected, all gold and predicted spans are still there, once each, and each pair took one of either."""
    before = label_outcomes(spark, sf_dir)
    after = matching.corrected(before)
    names = {x: F.col(x) for x in "mcsn"}
    a, b = evaluation.total_counts(before).toDF("b0", "b1", "b2", "b3"), evaluation.total_counts(after)
    golds, preds = gold(spark, sf_dir).agg(F.count(F.lit(1)).alias("gold")), pred(spark, sf_dir).agg(F.count(F.lit(1)).alias("pred"))
    one = golds.join(preds, F.lit(True)).join(a, F.lit(True)).join(b, F.lit(True))
    conserved = (names["m"] + names["c"] + names["s"] == F.col("pred")) & (names["m"] + names["c"] + names["n"] == F.col("gold")) & (names["s"] >= 0) & (names["n"] >= 0)
    taken = names["c"] - F.col("b1")
    return one.select("gold", "pred", conserved.alias("conserved"), ((F.col("b2") - names["s"] == taken) & (F.col("b3") - names["n"] == taken) & (names["m"] == F.col("b0"))).alias("paired"))


@query()
def wrong_label_matching(spark, sf_dir):
    """Tested against brute force: SQL has no augmenting paths."""
    return matching.align_wrong_labels(gold(spark, sf_dir), pred(spark, sf_dir))


@query()
def outcome_correct(spark, sf_dir):
    return evaluation.scored(_counts_by(corrected_counts(spark, sf_dir)))


# Gold spans go one by one: each takes the first prediction that equals it, or overlaps it and is free.
@query(f"""with recursive {SQL}, g as (select *, row_number() over (partition by doc_id order by s, e, lab) k from (select distinct * from gold)),
    p as (select doc_id, list({{'s': s, 'e': e, 'lab': lab}} order by s, e, lab) ps from (select distinct * from pred) group by doc_id),
    hits as (select g.*, coalesce(list_filter(range(1, coalesce(len(ps), 0) + 1), lambda j: least(ps[j].e, g.e) > greatest(ps[j].s, g.s)), []) near, coalesce(list_position(ps, {{'s': g.s, 'e': g.e, 'lab': g.lab}}), 0) same from g left join p using (doc_id)),
    steps(doc_id, k, used, again, hit) as (select distinct doc_id, 0::bigint, []::bigint[], 0::bigint, 0::bigint from base
        union all select doc_id, k, case when hit > 0 and not list_contains(used, hit) then list_append(used, hit) else used end, again + cast(hit > 0 and list_contains(used, hit) as bigint), hit
        from (select h.doc_id, h.k, st.used, st.again, coalesce(list_filter(h.near, lambda j: j = h.same or not list_contains(st.used, j))[1], 0) hit from steps st join hits h on h.doc_id = st.doc_id and h.k = st.k + 1)),
    last as (select doc_id, arg_max(used, k) used, max(again) again from steps group by doc_id),
    o as (select h.doc_id, case when hit = 0 then 'N' when hit = same then 'M' else 'C' end match_type, h.lab from steps join hits h using (doc_id, k)),
    spare as (select doc_id, greatest(0, len(list_filter(range(1, len(ps) + 1), lambda j: not list_contains(coalesce(used, []), j))) - coalesce(again, 0)) n from p left join last using (doc_id))
    select doc_id, match_type, count(*) n from o group by all union all select doc_id, 'S', n from spare where n > 0""")
def span_score_scorer(spark, sf_dir):
    """The older scorer's outcomes by document."""
    return alignment.legacy_counts(gold(spark, sf_dir), pred(spark, sf_dir))


_CAT = "case {0} when 2 then 1 when 3 then 2 when 4 then 3 else {0} end"


_BY_CATEGORY = outcomes_sql(False).replace("pk%5 lab from base),", _CAT.format("pk%5") + " lab from base),", 1)
_BY_CATEGORY = _BY_CATEGORY.replace("case when pk%9=0 then (pk+1)%5 else pk%5 end lab", _CAT.format("(case when pk%9=0 then (pk+1)%5 else pk%5 end)") + " lab", 1).replace("sk%5 from base where sk%7=0", _CAT.format("(sk%5)") + " from base where sk%7=0", 1)


@query(f"with recursive {_BY_CATEGORY} select * from outcomes")
def span_align_category(spark, sf_dir):
    """Labels are mapped to categories before spans are aligned."""
    code = F.when(F.col("lab") >= 2, F.col("lab") - 1).otherwise(F.col("lab"))
    return alignment.align(gold(spark, sf_dir).withColumn("lab", code), pred(spark, sf_dir).withColumn("lab", code), two_tier=False)


@query(f"with {SQL} select doc_id, g.s, g.e, p.s s2, p.e e2, round((least(g.e, p.e) - greatest(g.s, p.s)) / (greatest(g.e, p.e) - least(g.s, p.s)), 6) iou from gold g join pred p using (doc_id) where greatest(g.s, p.s) < least(g.e, p.e)")
def span_iou(spark, sf_dir):
    from ..operators.spans import overlap_join

    pairs = overlap_join(gold(spark, sf_dir), pred(spark, sf_dir))
    return pairs.select("doc_id", "s", "e", "s2", "e2", F.round(scores.overlap_ratio(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), 6).alias("iou"))


@query(f"with {SQL} select doc_id, s, e, s2, e2, least(e, e2) - greatest(s, s2) overlap from (select g.doc_id, g.s, g.e, p.s s2, p.e e2 from gold g join pred p on g.doc_id = p.doc_id) where greatest(s, s2) < least(e, e2)")
def span_overlap_len(spark, sf_dir):
    from ..operators.spans import overlap_join

    return overlap_join(gold(spark, sf_dir), pred(spark, sf_dir)).select("doc_id", "s", "e", "s2", "e2", "overlap")


_PAIRS_SQL = f"""{SQL}, mp as (select doc_id case_id, case when sk % 11 <> 0 then pk % 5 end label_1, case when sk % 13 <> 0 then case when pk % 9 = 0 then (pk + 1) % 5 else pk % 5 end end label_2, p_name text_1,
    case pk % 6 when 0 then p_name when 1 then '"' || p_name || '".' when 2 then substring(p_name, 1, 4) when 3 then 'other' else p_name end text_2, case sk % 4 when 0 then 'Both' when 1 then 'ONE' when 2 then 'TWO' end truth from base join part on p_partkey = pk)"""


def mention_pairs(spark, sf_dir):
    pk, sk, name = F.col("pk"), F.col("sk"), F.col("p_name")
    rows = base(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("pk"), "p_name"), "pk")
    other = F.when(pk % 6 == 1, F.concat(F.lit('"'), name, F.lit('".'))).when(pk % 6 == 2, F.substring(name, 1, 4)).when(pk % 6 == 3, "other").otherwise(name)
    return rows.select(
        F.col("doc_id").alias("case_id"), F.when(sk % 11 != 0, pk % 5).alias("label_1"), F.when(sk % 13 != 0, F.when(pk % 9 == 0, (pk + 1) % 5).otherwise(pk % 5)).alias("label_2"),
        name.alias("text_1"), other.alias("text_2"), F.when(sk % 4 == 0, "Both").when(sk % 4 == 1, "ONE").when(sk % 4 == 2, "TWO").alias("truth"),
    )


@query(f"""with {_PAIRS_SQL}, c as (select count(*) pairs, count(distinct case_id) cases, count(*) filter (where label_1 is not null and label_2 is not null) "both", count(*) filter (where label_1 = label_2) same, count(*) filter (where label_1 = label_2 and text_1 = text_2) ex, count(label_1) one, count(label_2) two,
    count(*) filter (where truth in ('Both', 'ONE', 'TWO')) res, count(*) filter (where truth in ('Both', 'ONE')) r1, count(*) filter (where truth in ('Both', 'TWO')) r2 from mp)
    select pairs, cases, "both", round(100 * same / "both", 6) label_agreement, round(ex / one, 6) strict_p, round(ex / two, 6) strict_r, round(2 * (ex / one) * (ex / two) / (ex / one + ex / two), 6) strict_f1, round(100 * r1 / res, 6) one_right, round(100 * r2 / res, 6) two_right from c""")
def iaa_summary(spark, sf_dir):
    return agreement.summarised(mention_pairs(spark, sf_dir))


@query(f"""with {_PAIRS_SQL}, k as (select case when label_1 is null or label_2 is null then 'unilateral' when label_1 <> label_2 then 'wrong label' when text_1 is distinct from text_2 then case when lower(trim(regexp_replace(trim(text_1), '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))) = lower(trim(regexp_replace(trim(text_2), '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))) then 'punctuation'
    when contains(lower(text_1), lower(text_2)) or contains(lower(text_2), lower(text_1)) then 'substring' else 'span' end end kind from mp), n as (select kind, count(*) n from k where kind is not null group by 1) select kind, n, round(100 * n / sum(n) over (), 6) percent from n""")
def iaa_discrepancies(spark, sf_dir):
    return agreement.discrepancies(mention_pairs(spark, sf_dir))


@query(f"with {_PAIRS_SQL} select label_1 label, count(*) n, count(*) filter (where label_1 = label_2) matched, round(100 * matched / n, 6) percent from mp where label_1 is not null and label_2 is not null group by 1")
def iaa_by_category(spark, sf_dir):
    return agreement.by_category(mention_pairs(spark, sf_dir))


@query(f"""with {SQL}, f as (select o_orderkey doc_id, (row_number() over (order by md5('42:' || o_orderkey), o_orderkey) - 1) place, count(*) over () n from orders) select doc_id, case when place < greatest(1, n // 10) then 'test' when place < greatest(1, n // 10) + greatest(1, n * 15 // 100) then 'dev' else 'train' end part from f""")
def split_train_dev_test(spark, sf_dir):
    return splits.fractions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), "doc_id", test=10, dev=15)


@query("""with d as (select o_orderkey doc_id, o_orderkey % 4 series from orders), h as (select unnest([0, 1, 2, 3]) held), x as (select *, row_number() over (partition by held order by md5('42:' || doc_id), doc_id) - 1 place, count(*) over (partition by held) n from d, h where series <> held)
    select held, 'test' part, count(*) n from d, h where series = held group by 1 union all select held, case when place < n * 15 // 100 then 'dev' else 'train' end, count(*) from x group by 1, 2""")
def loo_splits(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4).cast("int").alias("series"))
    return splits.leave_one_out(docs, "doc_id", "series", [0, 1, 2, 3], dev=15).groupBy("held", "part").agg(count_n())


@query("""with f as (select o_orderkey, o_orderstatus, cast((row_number() over (partition by o_orderstatus order by md5('42:' || o_orderkey), o_orderkey) - 1) % 5 as int) fold from orders), t as (select *, unnest(range(5)) test_fold from f)
    select cast(test_fold as int) test_fold, o_orderstatus, case when fold = test_fold then 'test' when fold = (test_fold + 1) % 5 then 'dev' else 'train' end part, count(*) n from t group by all""")
def stratified_cv(spark, sf_dir):
    dealt = splits.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, strata=["o_orderstatus"])
    return splits.cross_validation(dealt, 5).groupBy("test_fold", "o_orderstatus", "part").agg(count_n())


@query(f"with {SQL}, v as (select lab from gold where doc_id % 10 < 8 group by lab having count(*) >= (select count(*) // 6 from gold)) select doc_id, s, e, lab from gold semi join v using (lab)")
def split_valid_labels(spark, sf_dir):
    spans = gold(spark, sf_dir)
    return splits.frequent_labels(spans, spans.where("doc_id % 10 < 8"), "lab", spans.count() // 6)


@query("select o_orderkey % 4 series, count(*) n, count(*) > 0 filled from orders where o_orderkey % 3 = 0 group by 1")
def cohort_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").groupBy((F.col("o_orderkey") % 4).alias("series")).agg(count_n()).withColumn("filled", F.col("n") > 0)


_HEX = lambda of, at: f"('0x' || substr(md5({of}), {at}, 8))::bigint % {evaluation.PRIME}"
_DRAWN = " + ".join(f"cast((x * a + y * b) % {evaluation.PRIME} >= {bound} as int)" for bound in evaluation.draw_bounds())


@query(f"""{_O}, u as (select doc_id, {COUNTS_SQL} from outcomes group by 1), h as (select *, {_HEX('doc_id::varchar', 1)} x, {_HEX('doc_id::varchar', 9)} y from u),
    r as (select i, {_HEX("'replicate ' || i", 1)} a, {_HEX("'replicate ' || i", 9)} b from (select unnest(range(200)) i)), d as (select i, m, c, s, n, {_DRAWN} k from h, r),
    t as (select i, {', '.join(f'sum({x} * k)::bigint {x}' for x in 'mcsn')} from d group by 1), z as (select {scores_sql(12)} from t)
    select 200::bigint replicates, {', '.join(f'round(quantile_cont({x}, {q}), 6) {x}_{name}' for x in ('strict_f1', 'adapted_f1') for q, name in ((0.025, 'low'), (0.975, 'high')))} from z""")
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap(outcomes(spark, sf_dir), replicates=200)


@query(f"{_RUNS} select fold, seed, {COUNTS_SQL} from runs group by all")
def union_runs(spark, sf_dir):
    """The runs of each seed, written apart once and put together again."""
    out = new_folder(spark, "runs")
    files.write_runs(runs(spark, sf_dir), out)
    stored = spark.read.parquet(out)
    parts = [stored.where(F.col("seed") == seed) for seed in (42, 123, 456, 789, 1011)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("fold", "seed").agg(*evaluation.counts())


@query(f"""{_RUNS}, e as (select unnest(range(11)) fold, s.seed from (select unnest([42, 123, 456, 789, 1011]) seed) s), a as (select distinct fold, seed from runs) select 'missing' problem, cast(fold as int) fold, seed from (select cast(fold as bigint) fold, seed from e except select fold, seed from a) union all select 'extra', cast(fold as int), seed from (select cast(fold as bigint) fold, seed from a except select cast(fold as bigint), seed from e)""")
def expected_minus_actual(spark, sf_dir):
    """Combinations of fold and seed that should be there and aren't, and the other way round."""
    actual = runs(spark, sf_dir).select("fold", "seed").distinct()
    expected = spark.range(11).select(F.col("id").cast("int").alias("fold"), F.explode(F.array(*map(F.lit, (42, 123, 456, 789, 1011)))).alias("seed"))
    return expected.exceptAll(actual).select(F.lit("missing").alias("problem"), "*").unionByName(actual.exceptAll(expected).select(F.lit("extra").alias("problem"), "*"))


@query(f"{_RUNS}, x as (select seed, fold, {COUNTS_SQL} from runs group by all) select *, row_number() over (order by seed, fold) place from x")
def ordered_summaries(spark, sf_dir):
    from pyspark.sql import Window

    # As many rows as there are runs.
    return union_runs(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy("seed", "fold")))


def _long(df, section, name, values):
    """Rows (section, name, metric, value) of some columns."""
    wide = df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), *(F.col(v).cast("double").alias(v) for v in values))
    return wide.unpivot(["section", "name"], list(values), "metric", "value")


def _pair_name():
    return F.concat(F.col("gold_lab").cast("string"), F.lit(" > "), F.col("pred_lab").cast("string"))


@query()
def report_error_taxonomy(spark, sf_dir):
    """As one long table: outcomes before and after wrong labels are corrected, the most frequent pairs of labels of the corrected ones, and what their texts hold."""
    after = stored(matching.align_corrected_summed(gold(spark, sf_dir), pred(spark, sf_dir)), "corrected")
    wrong = after.where("subtype = 'wrong_label'").groupBy("gold_lab", "pred_lab").agg(count_n()).orderBy(F.desc("n"), "gold_lab", "pred_lab").limit(8)
    counts = after.agg(*(F.coalesce(F.sum(F.when(F.col("match_type") == x.upper(), F.col("n"))), F.lit(0)).alias(x) for x in "mcsn"), F.count_if(F.col("subtype") == "wrong_label").alias("pairs"))
    # A pair of wrong labels was a missed and a spurious span before.
    raw = counts.select("m", *((F.col(x) + sign * F.col("pairs")).alias(x) for x, sign in (("c", -1), ("s", 1), ("n", 1))))
    parts = [_long(raw, "raw", F.lit("all"), "mcsn"), _long(counts, "corrected", F.lit("all"), "mcsn"), _long(wrong, "confusions", _pair_name(), ["n"]), _long(_terms(spark, sf_dir, after, "wrong_label"), "terms", F.col("term"), ["n"])]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query()
def report_directional(spark, sf_dir):
    """As one long table: gold spans that the outcomes have too few or too many of, by label; directional scores by category once wrong labels are corrected; the most frequent pairs of labels."""
    after = stored(matching.align_corrected(gold(spark, sf_dir), pred(spark, sf_dir)), "corrected")
    given = gold(spark, sf_dir)
    held = after.where("match_type <> 'S'").select(F.col("gold_lab").alias("lab"))
    wrong = after.where("subtype = 'wrong_label'").groupBy("gold_lab", "pred_lab").agg(count_n()).orderBy(F.desc("n"), "gold_lab", "pred_lab").limit(8)
    scores_of = evaluation.by_category_directed(with_categories(spark, after))
    parts = [_long(tables.reconcile(given, held, "lab"), "reconcile", F.col("lab"), ["missing", "excess"]), _long(scores_of, "category", F.col("category"), [c for c in scores_of.columns if c != "category"]), _long(wrong, "confusions", _pair_name(), ["n"])]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query()
def report_model_performance(spark, sf_dir):
    """Strict and adapted scores of three ways to align the same spans."""
    found = matching.counts_by_document(gold(spark, sf_dir), pred(spark, sf_dir))
    names = dict(zip(("two tiers", "labels", "labels, corrected"), matching.WAYS, strict=True))
    sums = found.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in found.columns[1:]))
    each = sums.select(F.inline(F.array(*(F.struct(*(F.col(f"{way}_{x}").alias(x) for x in "mcsn"), F.lit(name).alias("model")) for name, way in names.items()))))
    return evaluation.scored(each).select("m", "c", "s", "n", *(f"{kind}_{x}" for kind in ("strict", "adapted") for x in ("p", "r", "f1")), "model")


@query()
def report_output_format(spark, sf_dir):
    """Scores with wrong labels corrected, by run."""
    return evaluation.scored(_counts_by(corrected_counts(spark, sf_dir), (F.col("doc_id") % 2).alias("run")))


@query()
def report_seed_reproducibility(spark, sf_dir):
    """Scores by seed, wrong labels corrected, and their average (seed -1)."""
    seeds = F.array(*map(F.lit, (42, 123, 456, 789, 1011)))
    seed = F.element_at(seeds, (F.floor(F.col("doc_id") / 10) % 5 + 1).cast("int")).alias("seed")
    each = evaluation.scored(_counts_by(corrected_counts(spark, sf_dir), seed)).select("seed", "strict_f1", "adapted_f1")
    return each.unionByName(each.agg(F.lit(-1).alias("seed"), F.round(F.avg("strict_f1"), 6).alias("strict_f1"), F.round(F.avg("adapted_f1"), 6).alias("adapted_f1")))


#: Versions of the taxonomy: the category of each label, from 0 on.
SCHEMAS = {"labels": ("AE", "SDRUG", "CDRUG", "LAB", "MHX"), "panel": ("AE", "DRUG", "DRUG", "LAB", "HX"), "history": ("AE", "DRUG", "DRUG", "OTHER", "OTHER"), "drugs": ("REST", "DRUG", "DRUG", "REST", "REST"), "any": ("ANY", "ANY", "ANY", "ANY", "ANY")}
_SCHEMA_ROWS = [(version, lab, category) for version, of in SCHEMAS.items() for lab, category in enumerate(of)]
_VERSIONED = re.sub(r"\b(base|gold|pred)\b", r"\1_0", SQL) + ", tax(version, lab, category) as (values " + ", ".join(f"('{v}', {lab}, '{c}')" for v, lab, c in _SCHEMA_ROWS) + """),
    base as (select distinct version || ':' || doc_id doc_id from base_0, (select distinct version from tax)), gold as (select version || ':' || doc_id doc_id, s, e, category lab from gold_0 join tax using (lab)), pred as (select version || ':' || doc_id doc_id, s, e, category lab from pred_0 join tax using (lab))"""


@query(f"""with recursive {outcomes_sql(True).replace(SQL, _VERSIONED, 1)}, u as (select match_type, split_part(doc_id, ':', 1) version, unnest(list_distinct(list_filter([gold_lab, pred_lab], lambda x: x is not null))) category from outcomes),
    x as (select version, category, {COUNTS_SQL} from u group by 1, 2 union all select split_part(doc_id, ':', 1), 'TOTAL', {COUNTS_SQL} from outcomes group by 1) select *, {scores_sql()} from x""")
def report_category_panel(spark, sf_dir):
    """Scores by category and in total under five versions of the taxonomy, whose spans are aligned in one pass."""
    taxonomy = spark.createDataFrame(_SCHEMA_ROWS, "version string, lab int, category string")
    return evaluation.by_version(gold(spark, sf_dir), pred(spark, sf_dir), taxonomy)


_SUMMARY = ("pairs", "cases", "both", "label_agreement", "strict_p", "strict_r", "strict_f1", "one_right", "two_right")


@query(f"""with s as ({ORACLE_SQL['iaa_summary']}), d as ({ORACLE_SQL['iaa_discrepancies']}), c as ({ORACLE_SQL['iaa_by_category']}), {_PAIRS_SQL},
    m as (select label_1 a, label_2 b, count(*) n from mp where label_1 is not null and label_2 is not null group by all), t as (select sum(n) n, sum(case when a = b then n else 0 end) same from m),
    pe as (select sum(cast(r.n as double) * q.n) chance from (select a k, sum(n) n from m group by 1) r join (select b k, sum(n) n from m group by 1) q using (k)), v as (select same / n::double po, chance / (n::double * n) pe from t, pe)
    {" union all ".join(f"""select 'summary' section, '' "name", '{x}' metric, cast("{x}" as double) "value" from s""" for x in _SUMMARY)}
    union all select 'kappa', '', 'observed', round(po, 6) from v union all select 'kappa', '', 'expected', round(pe, 6) from v union all select 'kappa', '', 'kappa', round((po - pe) / (1 - pe), 6) from v
    union all select 'discrepancies', kind, 'n', n from d union all select 'discrepancies', kind, 'percent', percent from d
    union all select 'category', cast(label as varchar), 'n', n from c union all select 'category', cast(label as varchar), 'matched', matched from c union all select 'category', cast(label as varchar), 'percent', percent from c""")
def report_iaa(spark, sf_dir):
    """All that is said of the agreement of two annotators, as one long table."""
    pairs = mention_pairs(spark, sf_dir)
    kappa = evaluation.agreement(pairs.select(F.col("label_1").alias("a"), F.col("label_2").alias("b")))
    parts = [_long(agreement.summarised(pairs), "summary", F.lit(""), _SUMMARY), _long(kappa, "kappa", F.lit(""), ["observed", "expected", "kappa"]), _long(agreement.discrepancies(pairs), "discrepancies", F.col("kind"), ["n", "percent"]), _long(agreement.by_category(pairs), "category", F.col("label"), ["n", "matched", "percent"])]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""with l as (select user_id log, max("value" / 2) v, count(*) points, max(event_id) last from events where "value" is not null group by user_id) select log % 3 model, count(*) runs, sum(points)::bigint points, round(avg(v), 6) best_mean, round(coalesce(stddev_samp(v), 0), 6) best_sd, max(last) last_step from l group by 1""")
def report_encoder_ablation(spark, sf_dir):
    """Training logs are written, scanned, and the best score of each summed up by model. Lines carry their log, so that files don't grow in number with the logs."""
    line = F.concat_ws("   ", F.expr("event_id div 7"), "event_id", "value", F.lit("0.5"), "user_id", F.lit("20"), F.lit("30"), F.col("value") / 2)
    out = new_folder(spark, "logs")
    rows = table(spark, sf_dir, "events").select(F.coalesce(F.when(F.col("value").isNotNull(), line), F.lit("done")).alias("value"), F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("log"))
    rows.select(F.concat("log", F.lit("\t"), "value").alias("value")).write.text(out)
    parts = F.split("value", "\t", 2)
    points = files.train_log(spark.read.text(out).select(F.get(parts, F.lit(1)).alias("value"), F.get(parts, F.lit(0)).try_cast("long").alias("log")), "log")
    best = points.groupBy("log").agg(F.max("score").alias("best"), count_n(), F.max("step").alias("last")).withColumn("model", F.col("log") % 3)
    return best.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("points"), F.round(F.avg("best"), 6).alias("best_mean"), F.round(F.coalesce(F.stddev_samp("best"), F.lit(0.0)), 6).alias("best_sd"), F.max("last").alias("last_step"))
