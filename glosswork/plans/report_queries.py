"""Reports put together from the annotation queries, and documents annotated by a caller's function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import register
from ..functions.udtfs import register_tables
from ..operators import labels as L
from ..operators.annotate import annotate_documents
from ..operators.corpus import source_matrix
from .anchor_queries import _TAGGED
from .annotation_queries import _A, _CANON, _HUMAN, _LAYER, admin_totals, label_distribution, user_distribution
from .fixtures import annotations, table, taxonomy
from .registry import ORACLE_SQL, query


@query(f"""{_A}, u as (select category lab, note src from norm where status = 'mapped' and note in ('SME1', 'ETHER', 'LLM')) select coalesce(lab, 'TOTAL') lab, count(*) filter (where src = 'SME1') "SME1", count(*) filter (where src = 'ETHER') "ETHER", count(*) filter (where src = 'LLM') "LLM" from u group by rollup(lab)""")
def report_annotator_matrix(spark, sf_dir):
    """Categories by annotator, and their totals."""
    found = L.normalized(annotations(spark, sf_dir), taxonomy(spark)).where("status = 'mapped' and note in ('SME1', 'ETHER', 'LLM')")
    return source_matrix(found.select(F.col("category").alias("lab"), "note"), "note", ["SME1", "ETHER", "LLM"])


@query(f"""{_A}, u as (select canonical lab, case when {_HUMAN} then 'human' else 'model' end src from norm where status = 'mapped'), m as (select coalesce(lab, 'TOTAL') lab, count(*) filter (where src = 'human') human, count(*) filter (where src = 'model') model from u group by rollup(lab))
    select *, (select count(distinct {_CANON}) from norm where status = 'unknown') unmapped from m""")
def report_vaccine_matrix(spark, sf_dir):
    """Labels by humans and models with their totals, beside the number of labels that the taxonomy lacks."""
    found = L.normalized(annotations(spark, sf_dir), taxonomy(spark))
    source = F.when(L.is_human(F.col("note")), "human").otherwise("model")
    matrix = source_matrix(found.where("status = 'mapped'").select(F.col("canonical").alias("lab"), source.alias("source")), "source", ["human", "model"])
    unmapped = found.where("status = 'unknown'").agg(F.count_distinct(L.canonical(F.col("label"))).alias("unmapped"))
    return matrix.crossJoin(F.broadcast(unmapped))


@query(f"""{_A}, x as (select {_CANON} label, {_LAYER} layer from ann), t as (select count(*) cases from orders), v as (select count(*) users from supplier), c as (select count(*) projects from customer)
    select 'totals' section, 'cases' metric, cases "value" from t union all select 'totals', 'users', users from v union all select 'totals', 'projects', projects from c union all select 'labels', label, count(*) from x group by label union all select 'users', cast(l_suppkey as varchar), count(*) from lineitem group by l_suppkey""")
def report_dashboard(spark, sf_dir):
    """Totals, labels and users as one long table."""
    totals = admin_totals(spark, sf_dir).unpivot([], ["cases", "users", "projects"], "metric", "value").select(F.lit("totals").alias("section"), "metric", "value")
    of_labels = label_distribution(spark, sf_dir).select(F.lit("labels").alias("section"), F.col("label").alias("metric"), F.col("total").alias("value"))
    of_users = user_distribution(spark, sf_dir).select(F.lit("users").alias("section"), F.col("user_id").cast("string").alias("metric"), F.col("n").alias("value"))
    return totals.unionByName(of_labels).unionByName(of_users)


def _numbers(text: str) -> list[dict]:
    """Spans of the words that are numbers; a text whose letters from A to Z are all upper case stops it."""
    import re

    if re.search("[A-Z]", text) and not re.search("[a-z]", text):
        raise ValueError("all upper case")
    return [{"s": m.start(), "e": m.end(), "lab": "NUMBER"} for m in re.finditer(r"\b[0-9]+\b", text, re.ASCII)]


@query(r"""with d as (select doc_id, text, regexp_matches(text, '[a-z]') or not regexp_matches(text, '[A-Z]') fine from documents where text is not null and doc_id not in (select doc_id from labels))
    select case when fine then 'ok' else 'error' end status, count(*) documents, cast(sum(case when fine then len(regexp_extract_all(text, '\b[0-9]+\b')) else 0 end) as bigint) spans from d group by 1""")
def annotated_documents(spark, sf_dir):
    """Documents without a label are annotated by a function; one that it fails on is a row with the error."""
    pending = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return annotate_documents(pending, _numbers).groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("spans")).cast("long").alias("spans"))


@query("""select s_suppkey, round(case when m + c + s > 0 then m / (m + c + s) else 0 end, 6) p from (select s_suppkey, s_suppkey % 5 m, s_suppkey % 3 c, s_suppkey % 2 s from supplier)""")
def sql_functions(spark, sf_dir):
    """Scores as functions of SQL."""
    register(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_glosswork_supplier")
    return spark.sql("select s_suppkey, round(prf_strict(s_suppkey % 5, s_suppkey % 3, s_suppkey % 2, 1).p, 6) p from _glosswork_supplier")


@query(r"""with p as (select doc_id, coalesce(text, '') t, least(3, length(coalesce(text, ''))) l, greatest(least(40, length(coalesce(text, ''))), least(3, length(coalesce(text, '')))) h from documents where text is not null), q as (select *, substring(t, l + 1, h - l) x from p), r as (select *, least(l + length(regexp_extract(x, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]*')), h) s from q)
    select doc_id, cast(s as int) s, cast(greatest(l + length(regexp_replace(x, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '')), s) as int) e from r""")
def sql_clean_span(spark, sf_dir):
    """Spans moved inwards past white space by a function of SQL."""
    register(spark)
    table(spark, sf_dir, "documents").where("text is not null").createOrReplaceTempView("_glosswork_documents")
    return spark.sql("select doc_id, clean_span(text, 3, 40).s s, clean_span(text, 3, 40).e e from _glosswork_documents")


def _document_view(spark, sf_dir):
    register_tables(spark)
    table(spark, sf_dir, "documents").where("text is not null").createOrReplaceTempView("_glosswork_documents")


@query(ORACLE_SQL["sliding_chunks"])
def sql_sliding_chunks(spark, sf_dir):
    """Chunks by a table function, joined from the side in SQL."""
    _document_view(spark, sf_dir)
    return spark.sql("select doc_id, c.chunk, c.s, c.e from _glosswork_documents, lateral sliding_chunks(text, 900, 150) c")


@query(ORACLE_SQL["parse_inline_tags"])
def sql_parse_inline_tags(spark, sf_dir):
    """Tags by a table function, joined from the side in SQL."""
    _document_view(spark, sf_dir)
    return spark.sql(f"select doc_id, md5(c.clean) clean, c.s, c.e, c.lab from (select doc_id, {_TAGGED} tagged from _glosswork_documents), lateral parse_inline_tags(tagged, map('AE', 'ADVERSE', 'LAB', 'TEST')) c where c.s is not null")
