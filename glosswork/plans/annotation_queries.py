"""Queries of stored annotations, their users, cases and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import tables
from ..sources.files import nonempty
from .fixtures import ANNOTATION_SQL, LENGTH, NOTES, annotations, gold, pred, table, taxonomy
from .registry import query

_A = f"with {ANNOTATION_SQL}"
_HUMAN = "(not regexp_matches(upper(note), 'AI|LLM|LLAMA|BERT') or contains(upper(note), 'VERIFIED'))"
_LAYER = f"case when {_HUMAN} then 'Human' when regexp_matches(upper(note), 'LLM|LLAMA') then 'LLM' when contains(upper(note), 'BERT') then 'BERT' else 'LLM' end"
_CANON = "case when lower(trim(label)) = 'r/o' then 'ro' else lower(trim(label)) end"


def count_n():
    return F.count(F.lit(1)).alias("n")


def length():
    return F.lit(LENGTH)


@query(f"{_A} select doc_id, ln, pk, label, canonical, category, status from norm")
def normalize_label(spark, sf_dir):
    return L.normalized(annotations(spark, sf_dir), taxonomy(spark)).select("doc_id", "ln", "pk", "label", "canonical", "category", "status")


@query(f"{_A} select label, {_CANON} canonical, count(*) n from ann group by all")
def canonical_label(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy("label", L.canonical(F.col("label")).alias("canonical")).agg(count_n())


@query(f"{_A} select reason, count(*) n from placed group by all")
def valid_offsets(spark, sf_dir):
    return L.with_offsets(annotations(spark, sf_dir), length()).groupBy("reason").agg(count_n())


@query(f"{_A} select doc_id, s, e, canonical label, category from placed where status = 'mapped' and reason = 'valid'")
def prepare_spans(spark, sf_dir):
    return L.prepared(annotations(spark, sf_dir), taxonomy(spark), length())


@query(f"""{_A} select count(*) seen, count(*) filter (where status = 'mapped' and reason = 'valid') kept, count(*) filter (where status = 'excluded') excluded, count(*) filter (where status = 'unknown') "unknown", count(*) filter (where status = 'mapped' and reason <> 'valid') invalid from placed""")
def loader_stats(spark, sf_dir):
    return L.loader_counts(annotations(spark, sf_dir), taxonomy(spark), length())


@query(r"""with d as (select doc_id, text, cast(doc_id % 50 as int) - 5 s, cast(doc_id % 50 + 40 + n_chars % 60 as int) e from documents where text is not null), c as (select *, least(greatest(s, 0), length(text)) lo from d), h as (select *, greatest(least(e, length(text)), lo) hi from c),
    p as (select *, substring(text, lo + 1, hi - lo) x from h), q as (select *, least(lo + length(x) - length(regexp_replace(x, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', '')), hi) ns, length(regexp_extract(x, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$')) r from p)
    select doc_id, cast(ns as int) s, cast(greatest(hi - r, ns) as int) e from q""")
def clean_span(spark, sf_dir):
    from ..operators.spans import clean_span as clean

    docs = table(spark, sf_dir, "documents").where("text is not null")
    s, e = clean(F.col("text"), (F.col("doc_id") % 50).cast("int") - 5, (F.col("doc_id") % 50 + 40 + F.col("n_chars") % 60).cast("int"))
    return docs.select("doc_id", s.alias("s"), e.alias("e"))


@query(f"{_A} select doc_id, ln, pk from ann where note = 'ETHER' and lower(trim(used)) = 'yes'")
def used_flag_filter(spark, sf_dir):
    return annotations(spark, sf_dir).where((F.col("note") == "ETHER") & (F.lower(F.trim("used")) == "yes")).select("doc_id", "ln", "pk")


@query(f"{_A} select note, {_HUMAN} human, count(*) n from ann group by all")
def human_or_verified(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy("note", L.is_human(F.col("note")).alias("human")).agg(count_n())


@query(f"""{_A} select doc_id, ln, pk, "text" from ann where lower(trim(label)) in ('ae', 'lab') and contains(lower("text"), 'wi')""")
def annotation_search(spark, sf_dir):
    return annotations(spark, sf_dir).where(F.lower(F.trim("label")).isin("ae", "lab") & F.lower("text").contains("wi")).select("doc_id", "ln", "pk", "text")


@query(f"{_A} select doc_id, label, s, e, row_number() over (partition by doc_id order by s, e, label, pk, ln) place from placed where {_CANON} in ('lab', 'mhx') and reason = 'valid'")
def temporal_terms(spark, sf_dir):
    """Labels that stand for times, in the order of their start in the document."""
    found = L.with_offsets(annotations(spark, sf_dir), length()).where("reason = 'valid'").where(L.canonical(F.col("label")).isin("lab", "mhx"))
    return found.select("doc_id", "label", "s", "e", F.row_number().over(Window.partitionBy("doc_id").orderBy("s", "e", "label", "pk", "ln")).alias("place"))


@query(f"{_A} select doc_id, ln, pk, label from ann where {_HUMAN} and {_CANON} in ('ae', 'sdrug', 'cdrug')")
def link_candidates(spark, sf_dir):
    return annotations(spark, sf_dir).where(L.is_human(F.col("note")) & L.canonical(F.col("label")).isin("ae", "sdrug", "cdrug")).select("doc_id", "ln", "pk", "label")


@query(f"""{_A}, t as (select distinct doc_id, s, e from placed where {_CANON} in ('lab', 'mhx') and reason = 'valid'), l as (select distinct doc_id, s, e from placed where {_CANON} = 'ae' and reason = 'valid')
    select t.* from t anti join l using (doc_id, s, e)""")
def unlinked_temporal(spark, sf_dir):
    found = L.with_offsets(annotations(spark, sf_dir), length()).where("reason = 'valid'").withColumn("c", L.canonical(F.col("label")))
    keys = ["doc_id", "s", "e"]
    return found.where(F.col("c").isin("lab", "mhx")).select(*keys).distinct().join(found.where("c = 'ae'").select(*keys).distinct(), keys, "left_anti")


@query(f"{_A} select distinct {_CANON} label from norm where status = 'unknown'")
def dq_unmapped_labels(spark, sf_dir):
    """Labels that the taxonomy lacks: empty where all is well."""
    return L.normalized(annotations(spark, sf_dir), taxonomy(spark)).where("status = 'unknown'").select(L.canonical(F.col("label")).alias("label")).distinct()


@query("select * from (select 'unexpected' problem, o_orderstatus \"value\" from (select distinct o_orderstatus from orders) where o_orderstatus not in ('F', 'O', 'X') union all select 'missing', 'X' from (select count(*) filter (where o_orderstatus = 'X') c from orders) where c = 0)")
def dq_domain(spark, sf_dir):
    """Values outside the domain, and those of it that are absent."""
    return tables.domain_problems(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "X"])


@query("""with d as (select distinct l_orderkey doc_id from lineitem), m as (select o_orderkey doc_id, case when o_orderkey % 5 < 4 then 'series ' || o_orderkey % 5 end series, o_orderkey % 3 = 0 included from orders where o_orderkey % 11 <> 0)
    select doc_id, case when m.included is null then 'no metadata' else 'included without a series' end problem from d left join m using (doc_id) where m.included is null or (included and series is null)""")
def dq_case_series(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    key = F.col("o_orderkey")
    meta = table(spark, sf_dir, "orders").where(key % 11 != 0).select(key.alias("doc_id"), F.when(key % 5 < 4, F.concat(F.lit("series "), (key % 5).cast("string"))).alias("series"), (key % 3 == 0).alias("included"))
    found = docs.join(meta, "doc_id", "left")
    problem = F.when(F.col("included").isNull(), "no metadata").when(F.col("included") & F.col("series").isNull(), "included without a series")
    return found.select("doc_id", problem.alias("problem")).where("problem is not null")


@query("select doc_id, lang, n_chars from documents where lang = 'en'")
def scan_documents(spark, sf_dir):
    """One corpus's documents; a corpus without any is an error."""
    return nonempty(table(spark, sf_dir, "documents").where("lang = 'en'"), "documents").select("doc_id", "lang", "n_chars")


@query(f"{_A} select a.doc_id, a.label, a.note from ann a join orders on o_orderkey = a.doc_id where o_orderstatus = 'F' and note = 'SME1'")
def scan_annotations_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return annotations(spark, sf_dir).where("note = 'SME1'").join(docs, "doc_id").select("doc_id", "label", "note")


@query(f"{_A} select a.doc_id, a.ln, a.pk, o_orderstatus dataset from ann a join orders on o_orderkey = a.doc_id")
def join_ann_doc(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("dataset"))
    return annotations(spark, sf_dir).select("doc_id", "ln", "pk").join(docs, "doc_id")


@query("select doc_id, count(*) n from (select l_orderkey doc_id from lineitem) join (select o_orderkey doc_id from orders where o_orderkey % 4 = 1) using (doc_id) group by doc_id")
def join_loo_docs(spark, sf_dir):
    series = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("doc_id"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).join(series, "doc_id").groupBy("doc_id").agg(count_n())


@query("select distinct l_orderkey doc_id from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 7 <> 0)")
def join_missing_metadata(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("doc_id"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).join(meta, "doc_id", "left_anti").distinct()


@query("select s_name username, r_name role, count(*) n from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by all")
def join_annotation_user_role(spark, sf_dir):
    users = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(count_n())
    return counts.join(users, "s_suppkey").groupBy(F.col("s_name").alias("username"), F.col("r_name").alias("role")).agg(F.sum("n").alias("n"))


@query("""select o_orderkey case_id, c_name owner, coalesce(n, 0) annotations, coalesce(users, 0) users from orders left join (select l_orderkey, count(*) n, count(distinct l_suppkey) users from lineitem group by 1) on l_orderkey = o_orderkey left join customer on c_custkey = o_custkey and c_custkey % 3 <> 0""")
def join_case_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("u"))
    owners = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    cases = table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(owners, F.col("o_custkey") == F.col("c_custkey"), "left")
    return cases.select(F.col("o_orderkey").alias("case_id"), F.col("c_name").alias("owner"), F.coalesce("n", F.lit(0)).alias("annotations"), F.coalesce("u", F.lit(0)).alias("users"))


@query(f"""{_A}, g as (select doc_id, count(*) n_gold from gold where lab <> 0 group by 1), p as (select doc_id, count(*) n_pred from pred where lab <> 1 group by 1)
    select doc_id, coalesce(n_gold, 0) n_gold, coalesce(n_pred, 0) n_pred from g full join p using (doc_id)""")
def join_gold_pred_text(spark, sf_dir):
    """Documents of either side with the spans of both, an empty list where a side has none."""
    lists = [df.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "lab")).alias(name)) for df, name in ((gold(spark, sf_dir).where("lab <> 0"), "g"), (pred(spark, sf_dir).where("lab <> 1"), "p"))]
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return lists[0].join(lists[1], "doc_id", "full").select("doc_id", size("g").alias("n_gold"), size("p").alias("n_pred"))


@query("""with f as (select o_orderkey || '-' || o_custkey % 3 file from orders), m as (select o_orderkey || '-1' file, o_orderpriority meta from orders) select file, meta from f left join m using (file)""")
def join_meta_by_case_version(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    files = orders.select(F.concat_ws("-", "o_orderkey", F.col("o_custkey") % 3).alias("file"))
    meta = orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("file"), F.col("o_orderpriority").alias("meta"))
    return files.join(meta, "file", "left")


@query("""with w as (select p_partkey, p_partkey || case p_partkey % 3 when 0 then '.json' else '' end name from part), s as (select p_partkey k, p_partkey || case p_size % 2 when 0 then '.json' else '' end stored from part where p_partkey % 7 <> 0)
    select p_partkey, stored, case when stored = name then 'exact' else 'other' end hit from w left join s on regexp_replace(stored, '\\.json$', '') = regexp_replace(name, '\\.json$', '')""".replace("\\\\", "\\"))
def case_lookup_fallback(spark, sf_dir):
    """The stored case of a name: the same, else with or without ``.json``."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    wanted = part.select("p_partkey", F.concat(key.cast("string"), F.when(key % 3 == 0, ".json").otherwise("")).alias("name"))
    stored = part.where("p_partkey % 7 <> 0").select(F.concat(key.cast("string"), F.when(F.col("p_size") % 2 == 0, ".json").otherwise("")).alias("stored"))
    found = tables.looked_up(wanted, stored, "name", "stored", ["p_partkey"])
    return found.select("p_partkey", "stored", F.when(F.col("stored") == F.col("name"), "exact").otherwise("other").alias("hit"))


@query(f"{_A}, u as (select s_suppkey id, upper(['sme1', 'SME2', 'ether'][s_suppkey + 1]) alias from supplier where s_suppkey < 3) select note, coalesce(id, 1) user_id, count(*) n from ann left join u on alias = upper(trim(note)) group by all")
def user_lookup(spark, sf_dir):
    users = table(spark, sf_dir, "supplier").where("s_suppkey < 3").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(F.lit("sme1"), F.lit("SME2"), F.lit("ether")), (F.col("s_suppkey") + 1).cast("int")).alias("alias"))
    notes = annotations(spark, sf_dir).groupBy("note").agg(count_n())
    return notes.join(users, F.upper(F.trim("note")) == F.upper("alias"), "left").select("note", F.coalesce("id", F.lit(1)).alias("user_id"), "n")


@query(f"{_A} select note, case when contains(note, 'SME1') then 1 when contains(note, 'SME2') then 2 when contains(note, 'LLM') then 3 else 0 end user_id, count(*) n from ann group by all")
def user_lookup_contains(spark, sf_dir):
    """The first alias that a note holds, else the administrator (0)."""
    aliases = ["SME1", "SME2", "LLM"]
    found = F.coalesce(*(F.when(F.col("note").contains(a), i) for i, a in enumerate(aliases, 1)), F.lit(0))
    return annotations(spark, sf_dir).groupBy("note").agg(count_n()).select("note", found.alias("user_id"), "n")


@query(f"""{_A} select label, coalesce(t.canonical, case lower(trim(label)) when 'xyz' then 'STATUS' end, upper(trim(label))) term, count(*) n from ann left join taxonomy t on lower(t.raw) = lower(trim(label)) group by all""")
def label_guideline_map(spark, sf_dir):
    """The official label of a free term: by its normal form, else by a dictionary, else itself."""
    found = L.normalized(annotations(spark, sf_dir), taxonomy(spark))
    other = F.when(F.lower(F.trim("label")) == "xyz", "STATUS").otherwise(F.upper(F.trim("label")))
    return found.groupBy("label", F.coalesce("canonical", other).alias("term")).agg(count_n())


@query(f"{_A} select {_CANON} label, count(*) n, count(distinct doc_id) documents from ann group by 1")
def label_counts(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy(L.canonical(F.col("label")).alias("label")).agg(count_n(), F.count_distinct("doc_id").alias("documents"))


@query(f"{_A} select t.category, coalesce(sum(c), 0)::bigint n from (select distinct category from taxonomy where category is not null) t left join (select category, count(*) c from norm where note = 'SME1' group by 1) using (category) group by 1")
def category_counts(spark, sf_dir):
    """Each category's annotations, 0 for one that has none."""
    counts = L.normalized(annotations(spark, sf_dir).where("note = 'SME1'"), taxonomy(spark)).groupBy("category").agg(count_n())
    return taxonomy(spark).where("category is not null").select("category").distinct().join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""{_A}, c as (select category, count(*) n from norm where note = 'ETHER' group by 1), b(category, source, shared) as (values ('AE', 'AE', false), ('DRUG', 'DRUG', true), ('VACCINE', 'DRUG', true), ('HX', null, false))
    select b.category, case when source is null then 'n/a' else coalesce(n, 0) || case when shared then '*' else '' end end shown from b left join c on c.category = b.source""")
def category_counts_shared(spark, sf_dir):
    """A coarse source's counts under each category that it stands for, marked where several share it."""
    bridge = spark.createDataFrame([("AE", "AE"), ("DRUG", "DRUG"), ("VACCINE", "DRUG"), ("HX", None)], "category string, source string")
    counts = L.normalized(annotations(spark, sf_dir).where("note = 'ETHER'"), taxonomy(spark)).groupBy(F.col("category").alias("source")).agg(count_n())
    shared = bridge.where("source is not null").groupBy("source").agg((F.count(F.lit(1)) > 1).alias("shared"))
    shown = F.when(F.col("source").isNull(), "n/a").otherwise(F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.when(F.col("shared"), "*").otherwise("")))
    return bridge.join(shared, "source", "left").join(counts, "source", "left").select("category", shown.alias("shown"))


@query(f"""{_A} select doc_id, count(*) filter (where note = 'LLM') llm, count(*) filter (where note = 'SME1') sme1, count(*) filter (where note = 'SME2') sme2, count(*) filter (where note not in ('LLM', 'SME1', 'SME2')) other from (select doc_id, case when pk % 6 <> 0 then note end note from ann) group by doc_id""")
def case_counts_by_source(spark, sf_dir):
    """Annotations by annotator; one without a name counts nowhere."""
    note = F.when(F.col("pk") % 6 != 0, F.col("note"))
    known = ("LLM", "SME1", "SME2")
    return annotations(spark, sf_dir).select("doc_id", note.alias("note")).groupBy("doc_id").agg(*(F.count_if(F.col("note") == k).alias(k.lower()) for k in known), F.count_if(~F.col("note").isin(*known)).alias("other"))


@query("""select (select count(*) from customer) projects, (select count(*) from orders) cases, (select count(*) from supplier) users, (select count(*) from events where cast(json_extract_string(props, '$.k') as int) % 10 = 0) done""")
def admin_totals(spark, sf_dir):
    ones = [table(spark, sf_dir, t).select(F.lit(name).alias("what"), F.lit(1).alias("x")) for t, name in (("customer", "projects"), ("orders", "cases"), ("supplier", "users"))]
    ones.append(table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("int") % 10 == 0).select(F.lit("done").alias("what"), F.lit(1).alias("x")))
    rows = ones[0].unionByName(ones[1]).unionByName(ones[2]).unionByName(ones[3])
    return rows.agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("projects", "cases", "users", "done")))


@query(f"{_A}, x as (select {_CANON} label, {_LAYER} layer from ann) select label, count(*) filter (where layer = 'Human') human, count(*) filter (where layer = 'LLM') llm, count(*) filter (where layer = 'BERT') bert, count(*) total from x group by label")
def label_distribution(spark, sf_dir):
    rows = annotations(spark, sf_dir).select(L.canonical(F.col("label")).alias("label"), L.layer(F.col("note")).alias("layer"))
    return rows.groupBy("label").agg(*(F.count_if(F.col("layer") == x).alias(x.lower()) for x in ("Human", "LLM", "BERT")), F.count(F.lit(1)).alias("total"))


_UI = """case when upper({0}) in ('AGE', 'SEX', 'GENDER', 'RACE', 'ETHNICITY', 'BIRTH', 'DEMOGRAPHIC') then 'DEMOGRAPHICS' when regexp_matches(upper({0}), 'AE|SYMPTOM|SIGN|COD|CAUSE OF DEATH') then 'ADVERSE EVENTS' when regexp_matches(upper({0}), 'MEDICAL HISTORY|BSYM|MHX|DIAGNOSTIC|R/O|MH') then 'MEDICAL HISTORY'
    when regexp_matches(upper({0}), 'DRUG|VACCINE|LAB|TREATMENT|PROCEDURE|DEVICE|MEDICATION') then 'INTERVENTIONS' when regexp_matches(upper({0}), 'TEMPORAL|DATE|TIME|DURATION|RELATIVE|LATENCY|FREQUENCY') then 'TEMPORAL' else 'OTHER' end"""


@query(f"{_A} select label, {_UI.format('label')} category from (select distinct label from ann)")
def ui_category(spark, sf_dir):
    return annotations(spark, sf_dir).select("label").distinct().select("label", L.ui_category(F.col("label")).alias("category"))


@query(f"{_A}, x as (select {_CANON} label, count(*) total from ann group by 1), c as (select {_UI.format('label')} category, * from x) select category, label, total, row_number() over (order by category, total desc, label) place from c")
def label_distribution_grouped(spark, sf_dir):
    counts = label_counts(spark, sf_dir).select(L.ui_category(F.col("label")).alias("category"), "label", F.col("n").alias("total"))
    # As many rows as there are labels: one task numbers them.
    return counts.withColumn("place", F.row_number().over(Window.orderBy("category", F.desc("total"), "label")))


@query("select l_suppkey user_id, count(*) n from lineitem group by 1")
def user_distribution(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("user_id")).agg(count_n())


@query("select s_name, n from (select l_suppkey, count(*) n from lineitem group by 1) join supplier on s_suppkey = l_suppkey order by n desc, s_name limit 10")
def top_users(spark, sf_dir):
    return user_distribution(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("user_id") == F.col("s_suppkey")).select("s_name", "n").orderBy(F.desc("n"), "s_name").limit(10)


_HALF = "substring(\"text\", 1, 3)"


@query(f"""{_A}, h as (select doc_id, {_UI.format('label')} category, lower({_HALF}) term, {_CANON} label, count(*) filter (where {_HUMAN}) human, count(*) filter (where not {_HUMAN}) ai from ann group by all)
    select category, term, label, sum(human)::bigint human, sum(ai)::bigint ai, sum(case when length(term) > 0 then (length(lower(coalesce(d.text, ''))) - length(replace(lower(coalesce(d.text, '')), term, ''))) // length(term) else 0 end)::bigint in_texts from h left join documents d using (doc_id) group by all""")
def inventory_counts(spark, sf_dir):
    """Terms (of three letters, so that texts hold some) by category and label: who marked them, and how often they stand in the texts of the documents that they were marked in."""
    rows = annotations(spark, sf_dir).withColumn("text", F.substring("text", 1, 3))
    return L.inventory(rows, table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("page")))


_TERM = """lower(trim(case when trim(text_raw) <> '' then text_raw else "text" end))"""


@query(f"{_A} select {_CANON} label, count(distinct nullif({_TERM}, '')) terms from ann group by 1")
def distinct_terms(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    term = L.terms(rows)
    return rows.groupBy(L.canonical(F.col("label")).alias("label")).agg(F.count_distinct(F.when(term != "", term)).alias("terms"))


@query(f"{_A} select {_TERM} term, count(*) n from ann group by 1 order by n desc, term limit 25")
def top_terms(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    return rows.groupBy(L.terms(rows).alias("term")).agg(count_n()).orderBy(F.desc("n"), "term").limit(25)


@query(f"{_A} select upper(trim(label)) label from ann union select unnest(['AE', 'STATUS'])")
def label_vocabulary(spark, sf_dir):
    defaults = spark.createDataFrame([("AE",), ("STATUS",)], "label string")
    return annotations(spark, sf_dir).select(F.upper(F.trim("label")).alias("label")).unionByName(defaults).distinct()


@query("select o_orderkey, count(*) over () total from orders where o_custkey % 2 = 0 order by o_orderkey limit 20 offset 40")
def case_page(spark, sf_dir):
    """A page of cases in the order of their ids, each with the number of all."""
    cases = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select("o_orderkey")
    return cases.orderBy("o_orderkey").offset(40).limit(20).crossJoin(F.broadcast(cases.agg(F.count(F.lit(1)).alias("total"))))


@query("select s_suppkey, s_name, coalesce(n, 0) n from supplier left join (select l_suppkey, count(*) n from lineitem where l_suppkey % 4 <> 0 group by 1) on l_suppkey = s_suppkey order by n desc, s_name limit 10")
def user_table(spark, sf_dir):
    counts = user_distribution(spark, sf_dir).where("user_id % 4 <> 0")
    users = table(spark, sf_dir, "supplier").join(counts, F.col("s_suppkey") == F.col("user_id"), "left")
    return users.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "s_name").limit(10)


@query("select doc_id, source from documents order by doc_id limit 50")
def first_n_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(50)


@query(f"""{_A}, x as (select *, {_LAYER} layer from placed where reason = 'valid'), r as (select *, row_number() over (partition by doc_id, s, e order by case layer when 'Human' then 1 when 'LLM' then 2 else 3 end, ln * 100000 + pk desc, note, label) k from x) select doc_id, s, e, layer, count(*) n from r where k = 1 group by all""")
def display_layer_pick(spark, sf_dir):
    found = L.with_offsets(annotations(spark, sf_dir), length()).where("reason = 'valid'").withColumn("ord", F.col("ln") * 100000 + F.col("pk"))
    # One annotation is picked of each span.
    return L.display_pick(found, "ord").select("doc_id", "s", "e", "layer", F.lit(1).cast("long").alias("n"))


@query("""with e as (select user_id, event_id, value, event_type <> 'error' ok from events) select user_id, max(event_id) event_id, arg_max(value, event_id) "value" from e where ok group by user_id""")
def latest_prediction(spark, sf_dir):
    """The last good record of each key."""
    return tables.latest(table(spark, sf_dir, "events").where("event_type <> 'error'"), ["user_id"], "event_id", ["value"])


@query(f"""{_A} select doc_id, coalesce((relation = 'date')::int, 0) rel_date, coalesce((relation = 'time')::int, 0) rel_time, count(*) n from (select doc_id, case when pk % 3 = 0 then 'date' when pk % 3 = 1 then 'time' end relation from ann) group by all""")
def relationship_flags(spark, sf_dir):
    pk = F.col("pk")
    json = F.when(pk % 3 == 0, '{"date": {"text": "May"}, "time": {"text": " "}}').when(pk % 3 == 1, '{"time": {"text": "noon"}}')
    spans = F.from_json(json, "map<string,struct<page:int,text:string,start:int,end:int>>")
    return annotations(spark, sf_dir).select("doc_id", spans.alias("r")).select("doc_id", *L.flags(F.col("r"), ("date", "time"))).groupBy("doc_id", "rel_date", "rel_time").agg(count_n())


@query("""select user_id, arg_max(event_type, event_id) status, arg_max(strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id) "timestamp" from events group by user_id""")
def adjudication_record(spark, sf_dir):
    """The last decision on each key as a JSON record."""
    record = F.to_json(F.struct(F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))
    latest = tables.latest(table(spark, sf_dir, "events").withColumn("record", record), ["user_id"], "event_id", ["record"])
    return latest.select("user_id", F.get_json_object("record", "$.status").alias("status"), F.get_json_object("record", "$.timestamp").alias("timestamp"))
