"""The registered queries of the annotation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, corpus, evaluation, spans, splits, tables
from .fixtures import CATEGORY_SQL, COUNTS_SQL, SQL, categories, gold, outcomes_sql, pred, scores_sql, table
from .registry import query

SEEDS = (42, 123, 456, 789, 1011)


def outcomes(spark: SparkSession, sf_dir: str, two_tier: bool = True) -> DataFrame:
    return alignment.align(gold(spark, sf_dir), pred(spark, sf_dir), two_tier=two_tier)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with a fold and a seed."""
    seeds = F.array(*(F.lit(x) for x in SEEDS))
    return outcomes(spark, sf_dir).withColumns({"fold": (F.col("doc_id") % 10).cast("int"), "seed": F.element_at(seeds, (F.floor(F.col("doc_id") / 10) % 5 + 1).cast("int"))})


_OVERLAP = f"with {SQL} select g.doc_id, g.s, g.e, g.lab, p.s s2, p.e e2, p.lab lab2, least(g.e, p.e) - greatest(g.s, p.s) overlap"
_PAIRS = "from gold g join pred p on g.doc_id = p.doc_id and greatest(g.s, p.s) < least(g.e, p.e)"
_RUNS = f"with recursive {outcomes_sql(True)}, runs as (select *, cast(doc_id % 10 as int) fold, [42, 123, 456, 789, 1011][doc_id // 10 % 5 + 1] seed from outcomes)"


@query(f"{_OVERLAP} {_PAIRS}")
def span_overlap_join(spark, sf_dir):
    return spans.overlap_join(gold(spark, sf_dir), pred(spark, sf_dir))


@query(f"{_OVERLAP}, g.s >= p.s and g.e <= p.e contained {_PAIRS}")
def span_containment_join(spark, sf_dir):
    return spans.containment_join(gold(spark, sf_dir), pred(spark, sf_dir))


# Equal spans are of one island whichever of them comes first.
@query(f"""with {SQL}, o as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) m from gold),
    i as (select *, cast(sum(case when m is null or s >= m then 1 else 0 end) over (partition by doc_id order by s, e) as int) island from o)
    select doc_id, island, min(s) s, max(e) e, count(*) n from i group by doc_id, island""")
def overlap_islands(spark, sf_dir):
    return spans.with_islands(gold(spark, sf_dir), stretch=spans.STRETCH).groupBy("doc_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {SQL}, o as (select *, row_number() over (partition by doc_id order by s, e desc, lab) k from gold),
    f(doc_id, k, s, e, lab, ends, kept) as (select doc_id, k, s, e, lab, e, true from o where k = 1 union all
        select o.doc_id, o.k, o.s, o.e, o.lab, case when o.s >= f.ends then o.e else f.ends end, o.s >= f.ends from f join o on o.doc_id = f.doc_id and o.k = f.k + 1)
    select doc_id, s, e, lab from f where kept""")
def span_dedupe_longest(spark, sf_dir):
    return spans.dedupe_longest(gold(spark, sf_dir))


@query(f"with {SQL}, o as (select *, lead(s) over (partition by doc_id order by s, e) nx from gold) select doc_id, bool_and(coalesce(nx >= e, true)) disjoint from o group by doc_id")
def no_overlap_check(spark, sf_dir):
    return spans.overlaps_nowhere(gold(spark, sf_dir))


@query(f"with {SQL} select distinct * from pred")
def distinct_spans(spark, sf_dir):
    return pred(spark, sf_dir).distinct()


@query(f"with recursive {outcomes_sql(False)} select * from outcomes")
def span_align_label(spark, sf_dir):
    return outcomes(spark, sf_dir, two_tier=False)


@query(f"with recursive {outcomes_sql(True)} select * from outcomes")
def span_align_two_tier(spark, sf_dir):
    return outcomes(spark, sf_dir)


@query(f"with recursive {outcomes_sql(True)} select match_type, subtype, count(*) n from outcomes group by all")
def mcsn_counts_subtype(spark, sf_dir):
    return evaluation.subtype_counts(outcomes(spark, sf_dir))


@query(f"with recursive {outcomes_sql(True)}, x as (select coalesce(gold_lab, pred_lab) lab, {COUNTS_SQL} from outcomes group by 1) select *, {scores_sql()} from x")
def per_label_metrics(spark, sf_dir):
    return evaluation.by_label(outcomes(spark, sf_dir))


@query(f"""with recursive {outcomes_sql(True)}, {CATEGORY_SQL}, u as (select o.*, unnest(list_distinct(list_filter([a.category, b.category], lambda x: x is not null))) category from outcomes o left join categories a on a.lab = gold_lab left join categories b on b.lab = pred_lab),
    x as (select category, {COUNTS_SQL} from u group by 1) select *, {scores_sql()} from x""")
def per_category_metrics_union(spark, sf_dir):
    return evaluation.by_category(outcomes(spark, sf_dir), categories(spark))


@query(f"{_RUNS}, x as (select seed, {COUNTS_SQL} from runs group by 1) select *, {scores_sql()} from x")
def pool_by_seed(spark, sf_dir):
    return evaluation.pooled(runs(spark, sf_dir), ["seed"])


@query(f"""{_RUNS}, x as (select fold, seed, {COUNTS_SQL} from runs group by 1, 2), y as (select fold, seed, {scores_sql()} from x)
    select fold, count(*) runs, round(avg(strict_f1), 6) strict_f1_mean, round(coalesce(stddev_samp(strict_f1), 0), 6) strict_f1_sd, round(avg(adapted_f1), 6) adapted_f1_mean, round(coalesce(stddev_samp(adapted_f1), 0), 6) adapted_f1_sd from y group by fold""")
def fold_seed_summary(spark, sf_dir):
    return evaluation.summary(evaluation.pooled(runs(spark, sf_dir), ["fold", "seed"]), ["fold"])


@query(f"with recursive {outcomes_sql(True)} select gold_lab, pred_lab, count(*) n from outcomes where subtype = 'class_confusion' group by all")
def confusion_pairs(spark, sf_dir):
    return evaluation.confusions(outcomes(spark, sf_dir))


@query(f"with recursive {outcomes_sql(True)} select gold_lab, pred_lab, count(*) n from outcomes where subtype = 'class_confusion' group by all order by n desc, gold_lab, pred_lab limit 8")
def top_confusions(spark, sf_dir):
    return evaluation.confusions(outcomes(spark, sf_dir)).orderBy(F.desc("n"), "gold_lab", "pred_lab").limit(8)


@query(f"""with {SQL}, x as (select pk%5 a, case when pk%9=0 then (pk+1)%5 else pk%5 end b from base where sk%11<>0 and sk%13<>0), n as (select count(*) n, count(*) filter (where a = b) same from x),
    pe as (select sum(cast(r.n as double) * c.n) chance from (select a k, count(*) n from x group by a) r join (select b k, count(*) n from x group by b) c using (k)),
    v as (select n, same / n::double po, chance / (n::double * n) pe from n, pe) select n, round(po, 6) observed, round(pe, 6) expected, round((po - pe) / (1 - pe), 6) kappa from v""")
def cohen_kappa(spark, sf_dir):
    from .fixtures import base

    pk, sk = F.col("pk"), F.col("sk")
    one, two = F.when(sk % 11 != 0, pk % 5), F.when(sk % 13 != 0, F.when(pk % 9 == 0, (pk + 1) % 5).otherwise(pk % 5))
    return evaluation.agreement(base(spark, sf_dir).select(one.alias("a"), two.alias("b")))


@query(f"""with {SQL}, u as (select lab, 'gold' src from gold union all select lab, 'pred' from pred)
    select coalesce(cast(lab as varchar), 'TOTAL') lab, count(*) filter (where src = 'gold') gold, count(*) filter (where src = 'pred') pred from u group by rollup(lab)""")
def source_matrix(spark, sf_dir):
    both = gold(spark, sf_dir).withColumn("source", F.lit("gold")).unionByName(pred(spark, sf_dir).withColumn("source", F.lit("pred")))
    return corpus.source_matrix(both, "source", ["gold", "pred"])


@query(f"with {SQL} select * from gold except all select * from pred")
def multiset_except(spark, sf_dir):
    return gold(spark, sf_dir).exceptAll(pred(spark, sf_dir))


@query(f"""with {SQL}, a as (select lab, count(*) n from gold group by lab), b as (select lab, count(*) n from pred group by lab)
    select lab, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) excess from a full join b using (lab)""")
def gold_reconcile(spark, sf_dir):
    return tables.reconcile(gold(spark, sf_dir), pred(spark, sf_dir), "lab")


_DEALT = "select o_orderkey, o_orderstatus, cast((row_number() over ({} order by md5('42:' || o_orderkey), o_orderkey) - 1) % 10 as int) fold from orders"


@query(_DEALT.format(""))
def round_robin_folds(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 10)


@query(_DEALT.format("partition by o_orderstatus"))
def stratified_folds(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 10, strata=["o_orderstatus"])


@query(f"""with f as ({_DEALT.format("")}), t as (select *, cast(unnest(range(10)) as int) test_fold from f)
    select test_fold, case when fold = test_fold then 'test' when fold = (test_fold + 1) % 10 then 'dev' else 'train' end part, count(*) n from t group by all""")
def cv_assign(spark, sf_dir):
    return splits.cross_validation(round_robin_folds(spark, sf_dir), 10).groupBy("test_fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query("select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def pending_work(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
