"""Gold and predicted spans derived from lineitem, in integer arithmetic that every engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("AE", "DRUG", "DRUG", "LAB", "HX")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"doc_id": "l_orderkey", "ln": "l_linenumber", "q": "l_quantity", "pk": "l_partkey", "sk": "l_suppkey"}
    return table(spark, sf_dir, "lineitem").select(*(F.col(c).cast("long" if n == "doc_id" else "int").alias(n) for n, c in columns.items()))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("ln") - 1) * 30 + F.col("pk") % 12
    return base(spark, sf_dir).select("doc_id", start.alias("s"), (start + 3 + F.col("q") % 25).alias("e"), (F.col("pk") % 5).alias("lab"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pk, sk, start = base(spark, sf_dir), F.col("pk"), F.col("sk"), (F.col("ln") - 1) * 30 + F.col("pk") % 12
    moved = rows.where(sk % 6 != 0).select("doc_id", (start + F.when(sk % 4 == 0, 2).otherwise(0)).alias("s"), (start + 3 + F.col("q") % 25).alias("e"), F.when(pk % 9 == 0, (pk + 1) % 5).otherwise(pk % 5).alias("lab"))
    tail = 300 + F.col("ln") * 40
    extra = rows.where(sk % 7 == 0).select("doc_id", tail.alias("s"), (tail + 5 + F.col("q") % 10).alias("e"), (sk % 5).alias("lab"))
    return moved.unionByName(extra)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "lab int, category string")


#: Labels as annotators write them, their notes, and the labels that the taxonomy knows (raw, canonical, category; null: excluded).
RAW_LABELS = ("AE", " ae ", "sDrug", "CDRUG", "lab", "mHx", "RO", "cod", "xyz", "r/o", "Dx")
NOTES = ("SME1", "SME2", "ETHER", "LLM", "BERT | VERIFIED BY SME1")
TAXONOMY = (("AE", "AE", "AE"), ("sDrug", "SDRUG", "DRUG"), ("cDrug", "CDRUG", "DRUG"), ("Lab", "LAB", "LAB"), ("MHx", "MHX", "HX"), ("Dx", "DX", "DX"), ("Status", "STATUS", "STATUS"), ("RO", None, None), ("COD", None, None))
#: Characters of a document that the annotations belong to.
LENGTH = 190


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "raw string, canonical string, category string")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ln, pk, sk, label, note, used, s, e (as text), text, text_raw."""
    pk, sk, start = F.col("pk"), F.col("sk"), (F.col("ln") - 1) * 30 + F.col("pk") % 12
    rows = base(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("pk"), F.col("p_name").alias("text")), "pk")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    return rows.select(
        "doc_id", "ln", "pk", "sk", pick(RAW_LABELS, pk % 11).alias("label"), pick(NOTES, sk % 5).alias("note"), F.when(sk % 3 == 0, "Yes").when(sk % 3 == 1, "no").alias("used"),
        F.when(pk % 13 == 0, "x").otherwise((start - F.when(pk % 7 == 0, 20).otherwise(0)).cast("string")).alias("s"), (start + 3 + F.col("q") % 25 - F.when(pk % 17 == 0, 40).otherwise(0)).cast("string").alias("e"),
        "text", F.when(pk % 4 == 1, "  ").when(pk % 4 > 1, F.concat(F.upper("text"), F.lit(" "))).alias("text_raw"),
    )


#: The same in SQL.
SQL = """
    base as (select cast(l_orderkey as bigint) doc_id, cast(l_linenumber as int) ln, cast(l_quantity as int) q, cast(l_partkey as int) pk, cast(l_suppkey as int) sk from lineitem),
    gold as (select doc_id, (ln-1)*30+pk%12 s, (ln-1)*30+pk%12+3+q%25 e, pk%5 lab from base),
    pred as (select doc_id, (ln-1)*30+pk%12+(case when sk%4=0 then 2 else 0 end) s, (ln-1)*30+pk%12+3+q%25 e, case when pk%9=0 then (pk+1)%5 else pk%5 end lab from base where sk%6<>0
        union all select doc_id, 300+ln*40, 300+ln*40+5+q%10, sk%5 from base where sk%7=0)"""
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
ANNOTATION_SQL = f"""{SQL},
    ann as (select doc_id, ln, pk, sk, {_LIST(RAW_LABELS)}[pk % 11 + 1] label, {_LIST(NOTES)}[sk % 5 + 1] note, case sk % 3 when 0 then 'Yes' when 1 then 'no' end used,
        case when pk % 13 = 0 then 'x' else cast((ln-1)*30+pk%12 - case when pk % 7 = 0 then 20 else 0 end as varchar) end s, cast((ln-1)*30+pk%12+3+q%25 - case when pk % 17 = 0 then 40 else 0 end as varchar) e,
        p_name "text", case when pk % 4 = 1 then '  ' when pk % 4 > 1 then upper(p_name) || ' ' end text_raw from base join part on p_partkey = pk),
    taxonomy(raw, canonical, category) as (values """ + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in t) + ")" for t in TAXONOMY) + f"""),
    norm as (select a.*, coalesce(x.canonical, y.canonical) canonical, coalesce(x.category, y.category) category, case when coalesce(x.raw, y.raw) is null then 'unknown' when coalesce(x.canonical, y.canonical) is null then 'excluded' else 'mapped' end status
        from ann a left join taxonomy x on x.raw = trim(a.label) left join taxonomy y on lower(y.raw) = lower(trim(a.label))),
    placed as (select * exclude (s, e), try_cast(s as int) s, try_cast(e as int) e, case when try_cast(s as int) is null or try_cast(e as int) is null then 'no number' when try_cast(s as int) < 0 then 'negative' when try_cast(s as int) >= try_cast(e as int) then 'empty' when try_cast(e as int) > {LENGTH} then 'beyond' else 'valid' end reason from norm)"""
CATEGORY_SQL = "categories(lab, category) as (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + ")"


def outcomes_sql(two_tier: bool) -> str:
    """CTEs that align gold with pred span by span: rows of outcomes."""
    other = 1 if two_tier else 0
    return f"""{SQL},
    g as (select *, row_number() over (partition by doc_id order by s, e, lab) k from gold),
    p as (select doc_id, list({{'s': s, 'e': e, 'lab': lab}} order by s, e, lab) ps from pred group by doc_id),
    steps(doc_id, k, used, code) as (
        select distinct doc_id, cast(0 as bigint), cast([] as bigint[]), cast(0 as bigint) from base
        union all
        select doc_id, k, case when code > 0 then list_append(used, 1000000 - code % 1000000) else used end, code from (
            select st.doc_id, g.k, st.used, coalesce(list_max(list_transform(range(1, len(p.ps) + 1), lambda j:
                case when list_contains(st.used, j) then 0
                when p.ps[j].s = g.s and p.ps[j].e = g.e and p.ps[j].lab = g.lab then 3000000000000 + (g.e - g.s) * 1000000 + 1000000 - j
                when least(p.ps[j].e, g.e) <= greatest(p.ps[j].s, g.s) then 0
                when p.ps[j].lab = g.lab then 2000000000000 + (least(p.ps[j].e, g.e) - greatest(p.ps[j].s, g.s)) * 1000000 + 1000000 - j
                else {other} * (1000000000000 + (least(p.ps[j].e, g.e) - greatest(p.ps[j].s, g.s)) * 1000000 + 1000000 - j) end)), 0) code
            from steps st join g on g.doc_id = st.doc_id and g.k = st.k + 1 left join p on p.doc_id = st.doc_id)),
    last as (select doc_id, arg_max(used, k) used from steps group by doc_id),
    outcomes as (
        select g.doc_id, case code // 1000000000000 when 3 then 'M' when 2 then 'C' when 1 then 'C' else 'N' end match_type,
            case code // 1000000000000 when 3 then 'exact' when 2 then 'boundary' when 1 then 'class_confusion' else 'missed' end subtype,
            g.s gold_s, g.e gold_e, g.lab gold_lab, case when code > 0 then ps[1000000 - code % 1000000].s end pred_s, case when code > 0 then ps[1000000 - code % 1000000].e end pred_e, case when code > 0 then ps[1000000 - code % 1000000].lab end pred_lab
        from steps join g using (doc_id, k) left join p using (doc_id)
        union all
        select doc_id, 'S', 'spurious', null, null, null, ps[j].s, ps[j].e, ps[j].lab
        from (select doc_id, ps, used, unnest(range(1, len(ps) + 1)) j from p left join last using (doc_id)) where not coalesce(list_contains(used, j), false))"""


def _ratio(top: str, bottom: str) -> str:
    return f"(case when {bottom} > 0 then ({top}) / ({bottom}) else 0.0 end)"


def scores_sql(digits: int = 6) -> str:
    """Select items: strict and adapted scores from m, c, s, n."""
    out = []
    r_bottom = "cast(m + c + n as double)"
    for kind, top, bottom in (("strict", "m", "cast(m + c + s as double)"), ("adapted", "m + 0.5::double * c", "m + c + 0.25::double * s")):
        p, r = _ratio(top, f"({bottom})"), _ratio(top, r_bottom)
        out += [f"round({p}, {digits}) {kind}_p", f"round({r}, {digits}) {kind}_r", f"round({_ratio(f'2 * {p} * {r}', f'({p} + {r})')}, {digits}) {kind}_f1"]
    return ", ".join(out)


COUNTS_SQL = ", ".join(f"count(*) filter (where match_type = '{x}') {x.lower()}" for x in "MCSN")
