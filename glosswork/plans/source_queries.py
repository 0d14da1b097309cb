"""Queries of scans, sinks, table maintenance and streams; files are derived from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from ..operators.evaluation import counts
from ..sources import files
from ..sources.folders import new_folder
from ..sources.keyed_table import KeyedTable
from ..streaming import cases, jobs
from .fixtures import ANNOTATION_SQL, COUNTS_SQL, annotations, outcomes_sql, table
from .queries import _RUNS, outcomes, runs
from .registry import query

_O = f"with recursive {outcomes_sql(True)}"
_EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def count_n():
    return F.count(F.lit(1)).alias("n")


def document_files(spark, sf_dir):
    """Conversations as document JSON, their turns as annotations."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    span = F.struct(F.lit(0).alias("page"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text"))
    one = F.struct("turn", F.upper("role").alias("label"), F.when(F.col("turn") % 2 == 0, "SME1").otherwise("SME2").alias("note"), span.alias("textContext"), F.lit(False).alias("disputed"))
    docs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("a"))
    out = new_folder(spark, "documents")
    docs.select(F.array(F.col("a")[0]["textContext"]["text"]).alias("pages"), F.transform("a", lambda x: F.struct(x["label"].alias("label"), x["note"].alias("note"), x["textContext"].alias("textContext"), x["disputed"].alias("disputed"))).alias("annotations"), F.col("conv_id").cast("string").alias("meta")).write.json(out)
    return out


@query("""with t as (select conv_id, min(turn) f, count(*) filter (where turn % 2 = 0) n from conversations where text is not null group by 1) select cast(t.conv_id as varchar) doc_id, c.text, t.n annotations from t join conversations c on c.conv_id = t.conv_id and c.turn = t.f""")
def scan_doc_json(spark, sf_dir):
    found = files.documents(spark, document_files(spark, sf_dir))
    return found.select(F.col("meta").alias("doc_id"), "text", F.size("annotations").cast("long").alias("annotations"))


@query("""with t as (select conv_id, min(turn) f from conversations where text is not null group by 1) select cast(t.conv_id as varchar) doc_id, c.text from t join conversations c on c.conv_id = t.conv_id and c.turn = t.f""")
def scan_text_only(spark, sf_dir):
    return files.texts(spark, document_files(spark, sf_dir)).select(F.col("meta").alias("doc_id"), "text")


@query("""select cast(user_id as varchar) document, max(event_id) number, cast(max(event_id) % 3 as bigint) entities from events where event_type <> 'error' and event_id % 17 <> 0 group by 1""")
def scan_predictions_jsonl(spark, sf_dir):
    entity = F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit("AE").alias("label"), F.lit("x").alias("text"))
    rows = table(spark, sf_dir, "events").withColumn("spans", F.slice(F.array(entity, entity), F.lit(1), (F.col("event_id") % 3).cast("int")))
    good = F.to_json(F.struct(F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("user_id").cast("string").alias("document"), F.col("spans").alias("predicted_entities"), F.col("event_id").alias("number")))
    out = new_folder(spark, "predictions")
    rows.select(F.when(F.col("event_id") % 34 == 0, '{"status": "ok", ').when(F.col("event_id") % 17 == 0, "").otherwise(good).alias("value")).write.text(out)
    return files.predictions(spark, out).select("document", "number", F.size("predicted_entities").cast("long").alias("entities"))


@query(f"{_O} select match_type, count(*) n from outcomes group by 1")
def scan_raw_results(spark, sf_dir):
    out = new_folder(spark, "outcomes")
    outcomes(spark, sf_dir).write.parquet(out)
    return files.checked(spark.read.parquet(out)).groupBy("match_type").agg(count_n())


def _run_folder(spark, sf_dir):
    out = new_folder(spark, "runs")
    files.write_runs(runs(spark, sf_dir), out)
    return out


@query(f"{_RUNS} select fold, seed, count(*) n from runs where fold < 3 group by all")
def scan_partitioned_runs(spark, sf_dir):
    """Folders of three folds alone are read; what is missing of the expected runs is an error."""
    seeds = F.array(*map(F.lit, (42, 123, 456, 789, 1011)))
    expected = spark.range(10).select(F.col("id").cast("int").alias("fold"), F.explode(seeds).alias("seed"))
    rows, missing = files.run_files(spark, _run_folder(spark, sf_dir), expected)
    if not missing.isEmpty():
        raise ValueError("runs are missing")
    return rows.where("fold < 3").groupBy("fold", "seed").agg(count_n())


@query(f"""{_RUNS}, f as (select fold, seed, count(*) n from runs group by all), e as (select unnest(range(11)) fold, s.seed from (select unnest([42, 123, 456, 789, 1011]) seed) s)
    select 'missing' problem, cast(fold as int) fold, seed, 1::bigint n from e where fold = 10 union all select 'missing', 3, 42, 1 union all select 'unexpected', 4, 7, 1 union all select 'duplicate', 5, 123, 2 union all select 'disagrees', fold, seed, n from f where fold = 6 and seed = 456 union all select 'disagrees', 4, 7, n from f where fold = 3 and seed = 42 union all select 'unnamed', null, null, 1""")
def scan_run_problems(spark, sf_dir):
    """Runs by the names of their folders: one that came under another name, one twice, one with other rows, one without a number, ten that never came."""
    found, is_run = runs(spark, sf_dir), lambda fold, seed: (F.col("fold") == fold) & (F.col("seed") == seed)
    name = F.format_string("fold_%02d_seed_%d_raw", F.when(is_run(3, 42), 4).otherwise(F.col("fold")), F.when(is_run(3, 42), 7).otherwise(F.col("seed")))
    again = F.when(is_run(5, 123) & (F.col("doc_id") % 20 >= 10), "fold_5_seed_123_raw").when(is_run(8, 789) & (F.col("match_type") == "N"), "notes").otherwise(name)
    named = found.withColumns({"run": again, "own_fold": F.when(is_run(6, 456), 0).otherwise(F.col("fold")), "own_seed": F.col("seed")}).drop("fold", "seed")
    out = new_folder(spark, "named")
    named.hint("rebalance", "run").write.partitionBy("run").parquet(out)
    seeds = F.array(*map(F.lit, (42, 123, 456, 789, 1011)))
    expected = spark.range(11).select(F.col("id").cast("int").alias("fold"), F.explode(seeds).alias("seed"))
    return files.named_runs(spark, out, expected)[1]


@query(f"{_RUNS} select fold, seed, {COUNTS_SQL} from runs group by all")
def sink_fold_results(spark, sf_dir):
    return spark.read.parquet(_run_folder(spark, sf_dir)).groupBy("fold", "seed").agg(*counts())


@query("select cast(o_orderkey % 10 as int) fold, 'case ' || o_orderkey doc_id from orders where o_custkey % 5 = 0")
def scan_manifest_folds(spark, sf_dir):
    each = table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").groupBy((F.col("o_orderkey") % 10).cast("string").alias("k"), (F.col("o_orderkey") % 7).alias("m")).agg(F.collect_list(F.concat(F.lit("case "), F.col("o_orderkey").cast("string"), F.lit(".json"))).alias("v"))
    manifests = each.select(F.to_json(F.struct(F.create_map("k", "v").alias("fold_documents"))).alias("json"))
    return files.manifest_folds(manifests, "json")


@query("""select event_id // 7 epoch, event_id step, "value" loss_trans, 0.5::double loss_ner, user_id / 100.0::double f, 0.2::double p, 0.3::double r, "value" / 2 score from events where "value" is not null and event_id % 5 <> 0""")
def scan_train_log(spark, sf_dir):
    line = F.concat_ws("   ", F.expr("event_id div 7"), "event_id", "value", F.lit("0.5"), "user_id", F.lit("20"), F.lit("30"), F.col("value") / 2)
    out = new_folder(spark, "logs")
    table(spark, sf_dir, "events").where("value is not null").select(F.when(F.col("event_id") % 5 != 0, line).when(F.col("event_id") % 2 == 0, "E    #    LOSS TRANS   LOSS NER  F P R SCORE").otherwise("done").alias("value")).write.text(out)
    return files.train_log(spark.read.text(out)).select("epoch", "step", "loss_trans", "loss_ner", *"fpr", "score")


@query("""select coalesce(cast(case when o_custkey % 9 <> 0 then o_orderkey end as varchar), '') case_number, coalesce(o_orderstatus, '') status from orders where o_orderkey > 4""")
def scan_case_export(spark, sf_dir):
    """Sheet rows, the header in the fifth; the rows above it are a title."""
    key = F.col("o_orderkey")
    cells = F.when(key < 4, F.array(F.lit("Report"), F.lit(None).cast("string"))).when(key == 4, F.array(F.lit("Status"), F.lit(" Case Number "))).otherwise(F.array(F.col("o_orderstatus"), F.when(F.col("o_custkey") % 9 != 0, key.cast("string"))))
    sheet = table(spark, sf_dir, "orders").select(key.alias("row_no"), cells.alias("cells"))
    return files.case_table(sheet).select("case_number", F.col("cells")[0].alias("status"))


@query("""select cast(user_id as varchar) "case", case event_id % 3 when 0 then event_type when 1 then event_type else 'UNKNOWN' end label, cast(event_id % 50 as int) s, cast(event_id % 50 + 4 as int) e, case when event_id % 2 = 0 then 'SME1' else 'Admin' end note from events""")
def scan_case_intake(spark, sf_dir):
    at, kind = (F.col("event_id") % 50).cast("int"), F.col("event_id") % 3
    flat = F.struct(F.when(kind == 0, F.col("event_type")).when(kind == 2, " ").alias("label"), F.when(kind == 1, F.col("event_type")).alias("type"), F.when(kind != 1, at).alias("start"), F.when(kind != 1, at + 4).alias("end"), F.when(kind == 1, F.struct(at.alias("start"), (at + 4).alias("end"))).alias("textContext"), F.when(F.col("event_id") % 2 == 0, "SME1").alias("note"))
    posts = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("case"), F.array(flat).alias("annotations"))).alias("json"))
    return files.intake(posts, "json")


@query("""with recursive """ + outcomes_sql(True) + """, d as (select doc_id, text from documents where text is not null) select o.doc_id, gold_s s, gold_e e, gold_lab label, substring(text, gold_s + 1, gold_e - gold_s) "text", md5(text) full_md5 from outcomes o join d using (doc_id) where match_type = 'N'""")
def sink_missing_entities(spark, sf_dir):
    """Missed spans with what stands there, written as CSV and read back."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    found = files.missing_entities(outcomes(spark, sf_dir), texts)
    out = new_folder(spark, "missing")
    options = {"header": True, "quoteAll": True, "escape": '"', "multiLine": True, "lineSep": "\x01", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    found.write.options(**options).csv(out)
    back = spark.read.options(**options).schema("doc_id long, s int, e int, label int, text string, full_text string").csv(out)
    return back.select("doc_id", "s", "e", "label", F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("full_text", F.lit("")).cast("binary")).alias("full_md5"))


@query(f"with {ANNOTATION_SQL} select doc_id, label, note, 1 page, s, e from placed where reason = 'valid'")
def sink_annotation_export(spark, sf_dir):
    """The flat export: pages count from one."""
    from ..operators.labels import with_offsets
    from .fixtures import LENGTH

    rows = with_offsets(annotations(spark, sf_dir), F.lit(LENGTH)).where("reason = 'valid'").select("doc_id", "label", "note", (F.lit(0) + 1).alias("page"), "s", "e")
    out = new_folder(spark, "export")
    rows.write.parquet(out)
    return spark.read.parquet(out)


@query(f"{_O} select count(distinct doc_id) documents, {COUNTS_SQL}, sha256('annotate this') prompt_sha256 from outcomes")
def sink_run_metadata(spark, sf_dir):
    row = files.run_metadata(outcomes(spark, sf_dir), "annotate this")
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return row.select(get("counts.documents").cast("long").alias("documents"), *(get(f"counts.{x}").cast("long").alias(x.lower()) for x in "MCSN"), get("prompt_sha256").alias("prompt_sha256"))


@query("""with o as (select c_custkey, c_name, c_mktsegment, 'old' meta, 0 updated_at from customer where c_custkey % 5 <> 4), n as (select c_custkey, case when c_custkey % 3 = 0 then ' ' when c_custkey % 3 = 1 then upper(c_name) end c_name, case when c_custkey % 2 = 0 then c_mktsegment || '+' end c_mktsegment, case when c_custkey % 7 <> 0 then 'new' end meta from customer where c_custkey % 5 <> 0)
    select coalesce(o.c_custkey, n.c_custkey) c_custkey, coalesce(nullif(trim(n.c_name), ''), o.c_name) c_name, coalesce(nullif(trim(n.c_mktsegment), ''), o.c_mktsegment) c_mktsegment, case when n.c_custkey is not null then n.meta else o.meta end meta, case when n.c_custkey is not null then 1 else o.updated_at end updated_at from o full join n on n.c_custkey = o.c_custkey""")
def merge_cases(spark, sf_dir):
    customers, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = customers.where(key % 5 != 4).select("c_custkey", "c_name", "c_mktsegment", F.lit("old").alias("meta"), F.lit(0).alias("updated_at"))
    new = customers.where(key % 5 != 0).select("c_custkey", F.when(key % 3 == 0, " ").when(key % 3 == 1, F.upper("c_name")).alias("c_name"), F.when(key % 2 == 0, F.concat("c_mktsegment", F.lit("+"))).alias("c_mktsegment"), F.when(key % 7 != 0, "new").alias("meta"))
    stored = KeyedTable(spark, new_folder(spark, "cases"), old.schema, ["c_custkey"], buckets=8)
    stored.merge(old, 0, lambda _, rows: rows)
    stored.merge(new.withColumn("updated_at", F.lit(1)), 1, lambda before, rows: tables.upsert(before, rows.drop("updated_at"), ["c_custkey"], always=["meta"], touched="updated_at", at=F.lit(1)))
    return stored.read()


@query("select c_custkey, coalesce(case when c_custkey % 3 = 1 then upper(c_name) end, case when c_custkey % 2 = 0 then c_name end) c_name from customer where c_custkey % 5 <> 4")
def backfill_cases(spark, sf_dir):
    customers, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = customers.where(key % 5 != 4).select("c_custkey", F.when(key % 2 == 0, F.col("c_name")).alias("c_name"))
    return tables.backfill(old, customers.select("c_custkey", F.when(key % 3 == 0, " ").when(key % 3 == 1, F.upper("c_name")).alias("c_name")), ["c_custkey"])


@query("select coalesce(o.n_nationkey, n.n_nationkey) n_nationkey, coalesce(n.n_name, o.n_name) n_name from (select n_nationkey, n_name from nation where n_nationkey < 20) o full join (select n_nationkey, case when n_nationkey % 2 = 0 then lower(n_name) end n_name from nation where n_nationkey > 10) n using (n_nationkey)")
def merge_project(spark, sf_dir):
    nations, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return tables.insert_or_keep(nations.where(key < 20).select("n_nationkey", "n_name"), nations.where(key > 10).select("n_nationkey", F.when(key % 2 == 0, F.lower("n_name")).alias("n_name")), ["n_nationkey"])


@query("select o_custkey project, o_orderkey case_id from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0")
def link_project_cases(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("case_id"))
    return tables.link(links.where("case_id % 3 <> 0"), links.where("case_id % 2 = 0"))


@query(f"with {ANNOTATION_SQL} select doc_id, note, label from ann where not (doc_id % 4 = 0 and note = 'LLM') union all select o_orderkey, 'LLM', 'AE' from orders where o_orderkey % 4 = 0 and o_orderkey in (select doc_id from ann where note = 'LLM')")
def replace_annotations(spark, sf_dir):
    """A case's annotations by one annotator go, and the new ones come in their place."""
    rows = annotations(spark, sf_dir).select("doc_id", "note", "label")
    touched = rows.where("doc_id % 4 = 0 and note = 'LLM'").select("doc_id").distinct()
    return tables.replace(rows, touched.select("doc_id", F.lit("LLM").alias("note"), F.lit("AE").alias("label")), ["doc_id", "note"])


@query("select 'cases' \"table\", count(*) n from orders where o_orderkey % 6 <> 0 union all select 'annotations', count(*) from lineitem where l_orderkey % 6 <> 0")
def cascade_delete(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    kept = tables.cascade({"cases": cases, "annotations": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"))}, cases.where("case_id % 6 = 0"), "case_id")
    rows = [df.agg(count_n()).select(F.lit(name).alias("table"), "n") for name, df in kept.items()]
    return rows[0].unionByName(rows[1])


@query(f"""with {ANNOTATION_SQL}, a as (select distinct doc_id, note, label from ann where note like '%LLM%'), r as (select o_orderkey doc_id, case when o_orderkey % 3 = 0 then 'verify' else 'reject' end verdict, 'SME' || o_custkey % 2 "user" from orders where o_orderkey % 2 = 0), j as (select * from a left join r using (doc_id))
    select doc_id, case verdict when 'verify' then note || ' | VERIFIED BY ' || "user" when 'reject' then note || ' | REJECTED BY ' || "user" else note end note, label from j union all select doc_id, "user", label from j where verdict = 'verify'""")
def apply_verify_reject(spark, sf_dir):
    rows = annotations(spark, sf_dir).where("note like '%LLM%'").select("doc_id", "note", "label").distinct()
    key = F.col("o_orderkey")
    reviews = table(spark, sf_dir, "orders").where(key % 2 == 0).select(key.alias("doc_id"), F.when(key % 3 == 0, "verify").otherwise("reject").alias("verdict"), F.concat(F.lit("SME"), F.col("o_custkey") % 2).alias("user"))
    return tables.reviewed(rows, reviews, ["doc_id"])


_LOG = """log as (select user_id * 100 + event_id // 40 % 100 k, event_id id, ['add', 'update', 'remove', 'dispute', 'undo'][(event_id % 5 + event_id // 40) % 5 + 1] action, event_id - 40 undoes, "value" v from events)"""


@query(f"""with {_LOG}, e as (select * from log where action <> 'undo' and id not in (select undoes from log where action = 'undo')), r as (select k, max(id) removed from e where action = 'remove' group by 1), l as (select e.* from e left join r using (k) where removed is null or id > removed)
    select k, arg_max(v, id) filter (where action in ('add', 'update')) "value", count(*) filter (where action = 'dispute') % 2 = 1 disputed from l group by k having count(*) filter (where action in ('add', 'update')) > 0""")
def replay_edit_log(spark, sf_dir):
    actions = F.array(*map(F.lit, ("add", "update", "remove", "dispute", "undo")))
    turn = F.expr("event_id div 40")
    log = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + turn % 100).alias("k"), F.col("event_id").alias("id"), F.get(actions, ((F.col("event_id") % 5 + turn) % 5).cast("int")).alias("action"), (F.col("event_id") - 40).alias("undoes"), "value")
    return tables.replayed(log, "k", "id")


def event_stream(spark, sf_dir):
    return spark.readStream.schema(_EVENT).parquet(f"{sf_dir}/events.parquet*")


@query("""select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events where event_type <> 'error' group by 1""")
def stream_prediction_cache(spark, sf_dir):
    return jobs.merge_latest(event_stream(spark, sf_dir), ["user_id"], "event_id", new_folder(spark, "cache"), good="event_type <> 'error'").select("user_id", "event_id", "event_type")


#: Sixteen events after one another edit one case: which does what, by its number among them.
_EDITS = {0: "post", 9: "post", 3: "add", 4: "add", 5: "undo", 6: "update", 10: "update", 7: "remove", 11: "remove", 12: "add", 13: "add", 14: "undo"}
_EDIT_SQL = "case event_id % 16 " + " ".join(f"when {k} then '{v}'" for k, v in _EDITS.items()) + " else 'update' end"


@query(f"""with e as (select event_id id, event_id // 16 % 50 k, {_EDIT_SQL} action, event_id % 4 j from events),
    p as (select k, max(id) p from e where action = 'post' group by 1), l as (select e.* from e left join p using (k) where p is null or id > p),
    posted as (select k, unnest(range(1 + p % 3)) j from p),
    touched as (select k, j, arg_max(action, id) action, max(id) id from l where action in ('update', 'remove') group by 1, 2),
    slots as (select coalesce(posted.k, touched.k) k, coalesce(posted.j, touched.j) j, action, touched.id, posted.k is not null posted from posted full join touched on posted.k = touched.k and posted.j = touched.j),
    added as (select k, id from l where action = 'add' and not exists (select 1 from l u where u.action = 'undo' and u.k = l.k and u.id - 2 = l.id)),
    found as (select k, 'L' || j label, j * 10 s from slots where action is distinct from 'remove' union all select k, 'E' || id, id % 50 from added)
    select k "case", count(*) n, string_agg(label || ' ' || s, ',' order by label) "set" from found group by 1""")
def stream_annotation_events(spark, sf_dir):
    """Cases after posts of one to three annotations, updates, removals, additions, and undone additions."""
    id, j = F.col("event_id"), F.col("event_id") % 4
    one = lambda label, s: F.struct(label.alias("label"), s.cast("int").alias("s"), (s + 4).cast("int").alias("e"), F.lit("").alias("text"), F.lit("SME1").alias("note"), F.lit(False).alias("disputed"))
    slot = lambda x: one(F.concat(F.lit("L"), x.cast("string")), x * 10)
    action = F.expr(_EDIT_SQL)
    held = F.when(action == "post", F.transform(F.sequence(F.lit(0).cast("long"), id % 3), slot)).when(action == "add", F.array(one(F.concat(F.lit("E"), id.cast("string")), id % 50))).otherwise(F.array(slot(j)))
    edits = event_stream(spark, sf_dir).select(F.expr("event_id div 16 % 50").alias("case"), id.alias("event"), "ts", action.alias("action"), held.alias("annotations"), (id - 2).alias("undoes"))
    found = cases.edited_cases(edits, new_folder(spark, "cases"))
    said = F.transform("annotations", lambda a: F.concat(a["label"], F.lit(" "), a["s"].cast("string")))
    return found.where(F.size("annotations") > 0).select("case", F.size("annotations").cast("long").alias("n"), F.array_join(F.array_sort(said), ",").alias("set"))


@query("select date_trunc('day', ts) start, event_type kind, count(*) n from events group by all")
def stream_progress_counts(spark, sf_dir):
    return jobs.progress_counts(event_stream(spark, sf_dir), "event_type", new_folder(spark, "progress"))
