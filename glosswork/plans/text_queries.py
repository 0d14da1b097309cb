"""Queries of the text columns, over documents, pages, conversations and the names in other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .fixtures import table
from .registry import query

_SPACE = r"\s\p{Z}\x1c-\x1f\x{85}"
_SENTENCES = rf"string_split(regexp_replace(text, '([.!?][{_SPACE}]+|[↵\n]+)', '\1' || chr(1), 'g'), chr(1))"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(rf"select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]')) as bigint) n_tokens from documents")
def tokenize_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.n_tokens(F.col("text")).alias("n_tokens"))


@query(rf"select doc_id, cast(coalesce(len(list_filter({_SENTENCES}, lambda x: regexp_matches(x, '[^{_SPACE}↵]'))), 0) as bigint) n_sentences from documents")
def split_sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.n_sentences(F.col("text")).alias("n_sentences"))


@query(f"""with p as (select doc_id, list_filter({_SENTENCES}, lambda x: x <> '') ps from documents where text is not null), e as (select doc_id, generate_subscripts(ps, 1) i, unnest(ps) x from p),
    o as (select doc_id, i, length(x) n, sum(length(x)) over (partition by doc_id order by i) e from e) select doc_id, i - 1 sentence, cast(e - n as bigint) s, cast(e as bigint) e from o""")
def sentence_offsets(spark, sf_dir):
    from ..operators.chunking import sentences

    return sentences(documents(spark, sf_dir)).select("doc_id", F.col("sentence").cast("long").alias("sentence"), "s", "e")


@query("select p_partkey, lower(trim(coalesce(case when trim(case when p_size % 3 = 0 then null when p_size % 3 = 1 then '  ' else upper(p_name) || ' ' end) <> '' then upper(p_name) || ' ' end, p_type))) term from part")
def normalized_term(spark, sf_dir):
    size = F.col("p_size") % 3
    raw = F.when(size == 1, F.lit("  ")).when(size == 2, F.concat(F.upper("p_name"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalized_term(raw, F.col("p_type")).alias("term"))


@query(r"select conv_id, turn, trim(regexp_replace(lower(text), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g')) term from conversations")
def normalize_ws_term(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.single_spaced(F.col("text")).alias("term"))


_BARE = r"regexp_replace({}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+$', '', 'g')"


@query(f"""select conv_id, turn, lower({_BARE.format(f"regexp_replace({_BARE.format("coalesce(text, '')")}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')")}) term from conversations""")
def clean_punct(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_punct(F.col("text")).alias("term"))


@query("""with x as (select conv_id, turn, lower(trim(text)) a, lower(trim(substring(text, 5 + cast(turn as int), 12 + cast(conv_id % 3 as int)) || case when conv_id % 4 = 0 then '?' else '' end)) b from conversations)
    select conv_id, turn, a <> '' and b <> '' and (contains(a, b) or contains(b, a)) related from x""")
def substring_relation(spark, sf_dir):
    part = F.concat(F.expr("substring(text, cast(5 + turn as int), cast(12 + conv_id % 3 as int))"), F.when(F.col("conv_id") % 4 == 0, "?").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.contain_each_other(F.col("text"), part).alias("related"))


@query(r"select doc_id, md5(regexp_replace(text, '[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}]|[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', '', 'g')) digest from documents")
def printable_only(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.printable(F.col("text"))).alias("digest"))


@query()
def mark_sections(spark, sf_dir):
    text = F.concat_ws(" ", F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 10), F.initcap("p_name"), F.lit("then"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.marked_sections(text).alias("html"))


@query(r"select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) digest from pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.without_tags(F.col("html"))).alias("digest"))


@query("select page_id, cast(length(regexp_replace(html, '<[^>]*>', '', 'g')) as bigint) n, regexp_replace(html, '<[^>]*>', '', 'g') = plain mapped from (select *, regexp_replace(html, '<[^>]*>', '', 'g') plain from pages)")
def html_text_mapping(spark, sf_dir):
    """The mapped places hold the plain text."""
    places = table(spark, sf_dir, "pages").select("page_id", "html", T.tag_free_places(F.col("html")).alias("at"))
    rebuilt = T.let(F.split("html", ""), lambda characters: F.array_join(F.transform("at", lambda i: F.get(characters, i)), ""))
    return places.select("page_id", F.size("at").cast("long").alias("n"), (rebuilt == F.regexp_replace("html", r"<[^>]*>", "")).alias("mapped"))


_OUTPUT = "case conv_id % 4 when 0 then chr(65279) || '```xml' || chr(10) || text || chr(10) || '```  ' when 1 then 'The annotated text is shown as below:' || chr(10) || text when 2 then '  ```' || chr(10) || 'THE ANNOTATED TEXT IS SHOWN AS BELOW: ' || text || '```' else text end"


@query(rf"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace({_OUTPUT}, chr(65279), ''), '^\s*```(?i:xml|html|text)?\s*\n?', ''), '\n?\s*```\s*$', ''), '^(?i)\s*The annotated text is shown as below:\s*(?:\r?\n)?', '') text from conversations where text is not null""")
def sanitize_output(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").where("text is not null").withColumn("output", F.expr(_OUTPUT.replace("chr(65279)", "'﻿'")))
    return found.select("conv_id", "turn", T.sanitized(F.col("output")).alias("text"))


@query("select doc_id, cast((length(lower(text)) - length(replace(lower(text), 'en', ''))) / 2 as bigint) n from documents where text is not null")
def count_occurrences(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", T.occurrences(F.col("text"), F.lit("EN")).alias("n"))


@query("""with c as (select conv_id, turn, text, substring(text, 3, 2) term from conversations where text is not null)
    select conv_id, turn, unnest(list_filter(range(0, length(text) - length(term) + 1), lambda i: substring(text, i + 1, length(term)) = term)) "at" from c where term <> ''""")
def exact_occurrences(spark, sf_dir):
    term = F.substring("text", 3, 2)
    found = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.explode(T.exact_occurrences(F.col("text"), term)).alias("at"))
    return found.withColumn("at", F.col("at").cast("long"))


@query("""with c as (select conv_id, turn, text, substring(text, 3, 2) term, cast(length(text) // 2 as int) x from conversations where text is not null)
    select conv_id, turn, cast(list_aggregate(list_transform(hits, lambda i: abs(i - x) * 1000000 + i), 'min') % 1000000 as int) "at" from (select *, case when term <> '' then list_filter(range(greatest(x - 40, 0), least(x + 40 + length(term), length(text)) - length(term) + 1), lambda i: substring(text, i + 1, length(term)) = term) else [] end hits from c)""")
def nearest_occurrence(spark, sf_dir):
    half = F.expr("cast(length(text) div 2 as int)")
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.nearest_occurrence(F.col("text"), F.substring("text", 3, 2), half, 40).alias("at"))


@query("select doc_id, translate(replace(text, chr(10), '↵'), '↵', chr(10)) = text same, length(text) n from documents where text is not null")
def normalize_newline(spark, sf_dir):
    """A text written with the mark for line ends gets them back, at the same places."""
    back = F.translate(F.replace("text", F.lit("\n"), F.lit("↵")), "↵", "\n")
    return documents(spark, sf_dir).where("text is not null").select("doc_id", (back == F.col("text")).alias("same"), F.length(back).cast("long").alias("n"))


@query("""with n as (select p_partkey, case when p_partkey % 3 = 0 then p_name else p_partkey || '-' || p_size end || case when p_size % 2 = 0 then '.json' else '' end x from part), b as (select p_partkey, regexp_replace(x, '\\.json$', '') x from n)
    select p_partkey, case when x like '_%-_%' then regexp_extract(x, '^(.+)-(.+)$', 1) else '0' end case_number, case when x like '_%-_%' then regexp_extract(x, '^(.+)-(.+)$', 2) else '1' end version from b""".replace("\\\\", "\\"))
def case_identifiers(spark, sf_dir):
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws("-", "p_partkey", "p_size")), F.when(F.col("p_size") % 2 == 0, ".json").otherwise(""))
    case, version = T.case_identifiers(name)
    return table(spark, sf_dir, "part").select("p_partkey", case.alias("case_number"), version.alias("version"))


_NUMBER = "case o_orderkey % 4 when 0 then cast(o_orderkey as varchar) || '.0' when 1 then '  ' when 2 then o_orderpriority else cast(o_custkey as varchar) end"


@query(f"select o_orderkey, case when trim(x) = '' then '0' else coalesce(cast(cast(trunc(try_cast(trim(x) as double)) as bigint) as varchar), trim(x)) end case_number from (select o_orderkey, {_NUMBER} x from orders)")
def normalize_case_no(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.case_number(F.expr(_NUMBER.replace("varchar", "string"))).alias("case_number"))


_LIST = "p_size % 4 || ') ' || p_name || '; 2) ' || p_type || ' ;; ' || p_brand"


@query(rf"""with l as (select p_partkey, list_filter(list_transform(string_split({_LIST}, ';'), lambda x: trim(x)), lambda x: x <> '') xs from part), e as (select p_partkey, generate_subscripts(xs, 1) - 1 place, unnest(xs) x from l)
    select p_partkey, cast(place as int) place, try_cast(nullif(regexp_extract(x, '^(\d+)\)\s*(.*)$', 1), '') as int) rank, case when regexp_matches(x, '^(\d+)\)\s*(.*)$') then trim(regexp_extract(x, '^(\d+)\)\s*(.*)$', 2)) else x end text from e""")
def parse_ranked_list(spark, sf_dir):
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.ranked_items(F.expr(_LIST.replace("p_size % 4", "cast(p_size % 4 as string)")))).alias("place", "x"))
    return found.select("p_partkey", "place", "x.rank", "x.text")


@query("""with l as (select p_partkey, list_transform(list_filter(string_split(p_name || ' ); ;' || p_type || ')', ';'), lambda x: trim(x) <> ''), lambda x: trim(x, ' ;)')) xs from part) select p_partkey, unnest(xs) item from l""")
def history_items(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.history_items(F.expr("p_name || ' ); ;' || p_type || ')'"))).alias("item"))


@query("""with l as (select p_partkey, p_name soc, case when p_size % 2 = 0 then '1) ' || p_type else '' end hlt, '2) ' || p_brand || '; 1) ' || p_type pt from part)
    select p_partkey, cast(k as int) term_id, case when k = 1 then soc else '' end soc, case when k = 1 and hlt <> '' then substring(hlt, 4) else '' end hlt, case when k = 1 then trim(substring(string_split(pt, ';')[2], 5)) else trim(substring(string_split(pt, ';')[1], 4)) end pt from l, (values (1), (2)) t(k)""")
def align_term_hierarchy(spark, sf_dir):
    """Terms of three levels side by side: by rank, else by place."""
    from ..operators.cases import aligned_terms

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("soc"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1) "), F.col("p_type"))).otherwise("").alias("hlt"), F.concat(F.lit("2) "), F.col("p_brand"), F.lit("; 1) "), F.col("p_type")).alias("pt"))
    return aligned_terms(rows, ["p_partkey"], ["soc", "hlt", "pt"])


@query("""with w as (select p_partkey, p_name n1, case p_size % 3 when 0 then 'Suspect' when 1 then ' concomitant ' else null end r1, case when p_partkey % 2 = 0 then p_type end n2, p_brand a2, 'SUSPECT' r2, case when p_partkey % 5 = 0 then 'x' || p_name end n10 from part),
    u as (select p_partkey, 1 product, n1 name, null active, r1 role from w union all select p_partkey, 2, n2, a2, r2 from w union all select p_partkey, 10, n10, null, null from w)
    select p_partkey, product, case lower(trim(coalesce(role, ''))) when 'suspect' then 'Suspect' when 'concomitant' then 'Concomitant' else 'Other' end role, coalesce(nullif(trim(name), ''), nullif(trim(active), ''), '(Unnamed Product)') display_name,
      cast((trim(coalesce(name, '')) <> '')::int + (trim(coalesce(active, '')) <> '')::int + (trim(coalesce(role, '')) <> '')::int as int) n_fields from u where n_fields > 0""")
def unpivot_products(spark, sf_dir):
    from ..operators.cases import products

    size, name = F.col("p_size") % 3, F.col("p_name")
    wide = table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("Product 1 Product Name"), F.when(size == 0, "Suspect").when(size == 1, " concomitant ").alias("Product 1 Role"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("Product 2 Product Name"),
        F.col("p_brand").alias("Product 2 Prod Active Ingred"), F.lit("SUSPECT").alias("Product 2 Role"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("x"), name)).alias("Product 10 Product Name"),
    )
    return products(wide, ["p_partkey"]).withColumn("n_fields", F.size("fields")).drop("fields")


@query("""with u as (select c_custkey, 1 k, 'Name' label, c_name v from customer union all select c_custkey, 2, 'Segment', case when c_custkey % 3 = 0 then '  ' else c_mktsegment end from customer union all select c_custkey, 3, 'Balance', case when c_custkey % 4 = 0 then null else cast(c_acctbal as varchar) end from customer)
    select c_custkey, k place, label, trim(v) "value" from u where trim(v) <> ''""")
def demographic_entries(spark, sf_dir):
    from ..operators.cases import entries

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("Name"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("Segment"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal").cast("string")).alias("Balance"))
    return entries(rows, ["c_custkey"], ["Name", "Segment", "Balance"])


@query("""select c_custkey, 'Name: ' || trim(c_name) || case when c_custkey % 3 = 0 then '' else chr(10) || 'Segment: ' || c_mktsegment end text from customer""")
def text_render_case(spark, sf_dir):
    from ..operators.cases import entries, rendered

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("Name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("Segment"))
    return rendered(entries(rows, ["c_custkey"], ["Name", "Segment"]), ["c_custkey"])


@query("""select event_id, cast(json_extract_string(props, '$.k') as int) k, 'Done' status, case when event_type = 'error' then 'yes' end failed from events where props is not null""")
def json_meta_patch(spark, sf_dir):
    meta = T.json_patched(F.col("props"), {"bert_processed": F.lit("Done"), "failed": F.when(F.col("event_type") == "error", "yes")})
    patched = table(spark, sf_dir, "events").where("props is not null").select("event_id", meta.alias("m"))
    return patched.select("event_id", F.get_json_object("m", "$.k").cast("int").alias("k"), F.get_json_object("m", "$.bert_processed").alias("status"), F.get_json_object("m", "$.failed").alias("failed"))


@query("""select event_id, case event_id % 3 when 2 then null else cast(json_extract_string(props, '$.k') as int) end k from events where props is not null""")
def json_extract_object(spark, sf_dir):
    wrapped = F.expr("case event_id % 3 when 0 then props when 1 then 'Here it is: ' || props || ' as asked' else 'nothing {' || event_type end")
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.get_json_object(T.json_object(wrapped), "$.k").cast("int").alias("k"))


@query("select conv_id, sha256(string_agg(text, chr(10) order by turn)) prompt_sha256 from conversations where text is not null group by conv_id")
def prompt_hash(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return turns.select("conv_id", F.sha2(F.array_join(F.col("x.text"), "\n").cast("binary"), 256).alias("prompt_sha256"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') iso from orders")
def iso_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("""select o_orderkey, case when o_orderstatus = 'P' then -2 when o_orderstatus = 'O' then -1 else o_custkey % 50 end code from orders""")
def file_status_code(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.status_code(status != "P", status == "F", F.col("o_custkey") % 50).alias("code"))


@query("select p_partkey, cast(p_size + 1 as bigint) n, printf('%.4f ± %.4f', p_size / 7.0, p_size / 9.0) score from part")
def pct_format(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 1).cast("long").alias("n"), T.percent_text(F.col("p_size") / F.lit(7.0), F.col("p_size") / F.lit(9.0)).alias("score"))


@query("select s_suppkey, s_name \"value\" from supplier")
def alias_column(spark, sf_dir):
    from ..operators.cases import first_existing

    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.select("s_suppkey", first_existing(suppliers, ["case name", "S_NAME", "s_acctbal"]).alias("value"))
