"""Queries of chunks, sentences and spans anchored in texts, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchoring, chunking, corpus, spans
from ..operators import labels as L
from .fixtures import ANNOTATION_SQL, SQL, annotations, gold, pred, table, taxonomy
from .registry import query


def count_n():
    return F.count(F.lit(1)).alias("n")


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


@query(r"""with recursive d as (select doc_id, text, length(text) n from documents where length(text) > 0), c(doc_id, chunk, s, e) as (
        select doc_id, 0, 0, case when n <= 900 then n else case when 900 - strpos(reverse(substring(text, 1, 900)), ' ') > 450 and strpos(reverse(substring(text, 1, 900)), ' ') > 0 then 900 - strpos(reverse(substring(text, 1, 900)), ' ') else 900 end end from d
        union all
        select doc_id, chunk + 1, s2, case when n <= s2 + 900 then n else case when strpos(reverse(substring(text, s2 + 1, 900)), ' ') > 0 and s2 + 900 - strpos(reverse(substring(text, s2 + 1, 900)), ' ') > s2 + 450 then s2 + 900 - strpos(reverse(substring(text, s2 + 1, 900)), ' ') else s2 + 900 end end
        from (select c.doc_id, chunk, text, n, greatest(s + 1, e - 150) + length(regexp_extract(substring(text, greatest(s + 1, e - 150) + 1, e - greatest(s + 1, e - 150)), '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]*')) s2, e from c join d using (doc_id) where e < n))
    select doc_id, chunk, cast(s as int) s, cast(e as int) e from c""")
def sliding_chunks(spark, sf_dir):
    return chunking.sliding_chunks(texts(spark, sf_dir)).select("doc_id", "chunk", "s", "e")


_SHIFT = "(s // 200) * 200"


@query(f"with {SQL} select doc_id, s, e, lab, least(s - {_SHIFT}, 300 - (e - {_SHIFT})) margin from gold")
def project_offsets(spark, sf_dir):
    """Spans within chunks of 300 characters that begin every 200, put back into their document."""
    at = F.floor(F.col("s") / 200).cast("int") * 200
    local = gold(spark, sf_dir).withColumn("at", at).withColumns({"s": F.col("s") - F.col("at"), "e": F.col("e") - F.col("at")})
    return chunking.projected(local, F.col("at"), F.col("at") + 300).select("doc_id", "s", "e", "lab", "margin")


@query(f"with {SQL} select doc_id, s, e, lab, least(s - {_SHIFT}, 300 - (e - {_SHIFT})) boundary from gold where lab = 0")
def boundary_margin(spark, sf_dir):
    return project_offsets(spark, sf_dir).where("lab = 0").withColumnRenamed("margin", "boundary")


# Spans go one by one: of the kept ones the first that overlaps gives way to a larger margin.
@query(f"""with recursive {SQL}, b as (select *, (s * 7 + e) % 50 margin from (select * from gold union all select * from pred)), o as (select *, row_number() over (partition by doc_id, lab order by s, e, -margin) k from b),
    f(doc_id, lab, k, kept) as (select doc_id, lab, 1::bigint, [{{'s': s, 'e': e, 'margin': margin}}] from o where k = 1 union all
        select doc_id, lab, k, case when hit is null then list_append(kept, x) when x.margin > kept[hit].margin then list_concat(kept[:hit - 1], [x], kept[hit + 1:]) else kept end
        from (select o.doc_id, o.lab, o.k, f.kept, {{'s': o.s, 'e': o.e, 'margin': o.margin}} x, list_filter(range(1, len(f.kept) + 1), lambda i: f.kept[i].s < o.e and o.s < f.kept[i].e)[1] hit from f join o on o.doc_id = f.doc_id and o.lab = f.lab and o.k = f.k + 1)),
    l as (select doc_id, lab, arg_max(kept, k) kept from f group by 1, 2) select doc_id, lab, x.s, x.e, x.margin from (select doc_id, lab, unnest(kept) x from l)""")
def span_dedupe_margin(spark, sf_dir):
    both = gold(spark, sf_dir).unionByName(pred(spark, sf_dir))
    return chunking.dedupe_margin(both.withColumn("margin", (F.col("s") * 7 + F.col("e")) % 50))


@query(f"""with recursive {SQL}, o as (select *, row_number() over (partition by doc_id order by s - e, s, lab) k from (select distinct * from gold)),
    f(doc_id, k, kept) as (select doc_id, 1::bigint, [{{'s': s, 'e': e, 'lab': lab}}] from o where k = 1 union all
        select o.doc_id, o.k, case when len(list_filter(f.kept, lambda x: x.s < o.e and o.s < x.e)) = 0 then list_append(f.kept, {{'s': o.s, 'e': o.e, 'lab': o.lab}}) else f.kept end from f join o on o.doc_id = f.doc_id and o.k = f.k + 1),
    l as (select doc_id, arg_max(kept, k) kept from f group by 1) select doc_id, x.s, x.e, x.lab from (select doc_id, unnest(kept) x from l)""")
def span_filter_longest_first(spark, sf_dir):
    return spans.longest_first(gold(spark, sf_dir).distinct())


_TAGGED = "substring(text, 1, 5) || '<AE>' || substring(text, 6, 7) || '</ae>' || substring(text, 13, 4) || case doc_id % 3 when 0 then '< Lab >' || substring(text, 17, 3) || '</LAB>' else '' end || substring(text, case doc_id % 3 when 0 then 20 else 17 end)"


@query("""with d as (select doc_id, text, cast(length(text) as int) n from documents where text is not null) select doc_id, md5(text) clean, 5 s, least(12, n) e, 'ADVERSE' lab from d where n > 5 union all select doc_id, md5(text), 16, least(19, n), 'TEST' from d where doc_id % 3 = 0 and n > 16""")
def parse_inline_tags(spark, sf_dir):
    """Tags around the sixth to the twelfth character, and of every third text around three more; in short texts they hold less, or nothing."""
    tagged = texts(spark, sf_dir).select("doc_id", F.expr(_TAGGED).alias("text"))
    found = anchoring.parsed_tags(tagged, {"AE": "ADVERSE", "LAB": "TEST"})
    return found.select("doc_id", F.md5("clean").alias("clean"), F.explode("spans").alias("x")).select("doc_id", "clean", "x.s", "x.e", "x.lab")


_INWARDS = r"""select doc_id, s + length(regexp_extract(x, '^[\s\p{Z}\x1c-\x1f\x{85}]*')) s, s + length(regexp_replace(x, '[\s\p{Z}\x1c-\x1f\x{85}]+$', '')) e, lab from (select *, substring(text, s + 1, e - s) x from t)"""


@query(f"""with d as (select doc_id, text, length(text) n from documents where text is not null), t as (select doc_id, text, 5 s, least(12, n) e, 'ADVERSE' lab from d union all select doc_id, text, 16, least(19, n), 'TEST' from d where doc_id % 3 = 0),
    c as ({_INWARDS}) select doc_id, cast(s as int) s, cast(e as int) e, lab from c where s < e""")
def anchor_tag_spans(spark, sf_dir):
    """Tags stand where they stood; every fourth output has words before and after that aren't in its text."""
    tagged = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Certainly, \u2042\u2042: "), F.expr(_TAGGED), F.lit(" \u2042\u2042"))).otherwise(F.expr(_TAGGED))
    found = anchoring.anchored_tags(texts(spark, sf_dir).select("doc_id", tagged.alias("text")), texts(spark, sf_dir), {"AE": "ADVERSE", "LAB": "TEST"})
    return found.select("doc_id", "s", "e", "lab")


_TURNS = "d as (select conv_id * 1000 + turn doc_id, text from conversations where text is not null)"
_MENTIONS = f"{_TURNS}, m as (select doc_id, text, substring(text, 3, 2) surface, unnest([0, 1, 2, 3, 4]) place from d), o as (select *, case when surface <> '' then list_filter(range(0, length(text) - length(surface) + 1), lambda i: substring(text, i + 1, length(surface)) = surface) else [] end hits from m)"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def mentions(spark, sf_dir):
    """Five mentions of two characters of each turn, by turns under two labels."""
    rows = turns(spark, sf_dir).select("doc_id", F.substring("text", 3, 2).alias("surface"), F.explode(F.array(*map(F.lit, range(5)))).alias("place"))
    return rows.withColumn("lab", F.when(F.col("place") % 2 == 0, "AE").otherwise("LAB"))


# Of the five, labels by turns: what each takes where there are 1, 2, 3, 4 or more occurrences.
_TAKEN = "case len(hits) when 0 then null when 1 then [0, 0, null, null, null] when 2 then [0, 1, 1, 0, null] when 3 then [0, 1, 2, 0, 1] when 4 then [0, 1, 2, 3, 1] else [0, 1, 2, 3, 4] end"


@query(f"""with {_MENTIONS} select doc_id, place, hits[({_TAKEN})[place + 1] + 1] s from o""")
def kth_mention_anchor(spark, sf_dir):
    return anchoring.anchored_surfaces(mentions(spark, sf_dir), turns(spark, sf_dir)).select("doc_id", "place", F.col("s").cast("long").alias("s"))


# What is exact once more is like itself; two characters that no text holds are like nothing. Ten characters with one changed are like the ten
# where the five after it stand at their own place first. Else a window must be like enough by its matching blocks: the longest one, the first
# of equals in the surface and then in the window, and so on at both sides of it.
_LIKE = """f as (select doc_id, text, substring(text, 1, 4) || '\u2042' || substring(text, 6, 5) x from d where length(text) >= 10 and strpos(substring(text, 1, 10), substring(text, 6, 5)) < 6),
    w0 as (select distinct doc_id, x, substring(text, s + 1, n) w from (select *, unnest(range(length(text))) s from f), (select unnest([7, 10, 13]) n)),
    w as (select * from w0 where 2 * len(list_filter(range(1, 11), lambda i: contains(w, substring(x, i, 1)))) / (10 + length(w)) >= 0.8::double),
    b(doc_id, x, w, a0, a1, b0, b1, got) as (select doc_id, x, w, 0::bigint, 10::bigint, 0::bigint, length(w), 0::bigint from w union all
        select doc_id, x, w, unnest([a0, i + n]), unnest([i, a1]), unnest([b0, j + n]), unnest([j, b1]), unnest([n, 0]) from (select *, best // 10000 n, 99 - best // 100 % 100 i, 99 - best % 100 j from (select *,
            list_max(flatten(list_transform(range(a0, a1), lambda i: list_transform(range(b0, b1), lambda j: coalesce(list_max(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda n: substring(x, i + 1, n) = substring(w, j + 1, n))), 0) * 10000 + (99 - i) * 100 + 99 - j)))) best from b) where best >= 10000)),
    alike as (select distinct doc_id from (select doc_id, w, sum(got) got from b group by all) where 2 * got / (10 + length(w)) >= 0.8::double)"""


@query(f"""with recursive {_MENTIONS}, {_LIKE}, x as (select case when surface = '' then 'unmapped' when hits[({_TAKEN})[place + 1] + 1] is not null then 'exact' else 'fuzzy' end how from o union all select 'unmapped' from d
        union all select case when length(text) >= 10 and (doc_id in (select doc_id from alike) or doc_id not in (select doc_id from f)) then 'fuzzy' else 'unmapped' end from d)
    select how, count(*) n from x group by 1""")
def anchor_json_entities(spark, sf_dir):
    """Surfaces by category in JSON, and how many of them were anchored, in which way."""
    from ..functions.text import json_object

    surface, changed = F.substring("text", 3, 2), F.when(F.length("text") >= 10, F.concat(F.substring("text", 1, 4), F.lit("\u2042"), F.substring("text", 6, 5))).otherwise("\u2042\u2042")
    lists = F.create_map(F.lit("AE"), F.array(surface, F.lit("\u2042\u2042\u2042"), surface, surface), F.lit("LAB"), F.array(surface, changed, surface))
    output = F.concat(F.lit("The entities: "), F.to_json(lists), F.lit(" as asked"))
    parsed = turns(spark, sf_dir).select("doc_id", F.explode(F.from_json(json_object(output), "map<string,array<string>>")).alias("lab", "all")).select("doc_id", "lab", F.posexplode("all").alias("k", "surface"))
    # Of the two lists the mentions are taken by turns.
    ordered = parsed.withColumn("place", F.when(F.col("surface").contains("\u2042"), F.col("k") + 100).when(F.col("lab") == "LAB", F.when(F.col("k") == 0, 1).otherwise(3)).otherwise(F.when(F.col("k") == 0, 0).otherwise(2 * (F.col("k") - 1)))).drop("k")
    return anchoring.anchored_entities(ordered, turns(spark, sf_dir)).groupBy("how").agg(count_n())


@query(f"""with {_TURNS} select doc_id, case when length(text) >= 22 then 3 end s, case when length(text) >= 22 then 22 end e from d""")
def fuzzy_anchor(spark, sf_dir):
    """Surfaces that were changed in one place are found where they stood; a turn that is too short for it has none."""
    rows = turns(spark, sf_dir)
    changed = F.when(F.length("text") >= 22, F.concat(F.expr("substring(text, 4, 9)"), F.lit("\u2042"), F.expr("substring(text, 14, 9)"))).otherwise("\u2042\u2042")
    return anchoring.fuzzy_anchored(rows.select("doc_id", changed.alias("surface")), rows).select("doc_id", "s", "e")


# A turn that ends early gives a shorter surface, or none.
@query("""with d as (select conv_id * 1000 + turn doc_id, text from conversations where text is not null), c as (select doc_id, text, substring(text, 8, 6) surface, 7 + cast(doc_id % 3 as int) * 5 claimed from d where length(text) > 7),
    x as (select *, cast(length(surface) as int) n, list_filter(range(greatest(claimed - 800, 0), least(claimed + 800 + n, length(text)) - n + 1), lambda i: substring(text, i + 1, length(surface)) = surface) hits from c)
    select distinct doc_id, 'AE' lab, s, s + n e from (select doc_id, n, case when substring(text, claimed + 1, n) = surface then claimed else cast(list_aggregate(list_transform(hits, lambda i: abs(i - claimed) * 1000000 + i), 'min') % 1000000 as int) end s from x) where s is not null""")
def json_offset_spans(spark, sf_dir):
    claims = turns(spark, sf_dir).select("doc_id", F.lit("AE").alias("lab"), (7 + (F.col("doc_id") % 3) * 5).cast("int").alias("s"), F.substring("text", 8, 6).alias("surface"))
    return anchoring.anchored_offsets(claims, turns(spark, sf_dir))


_SENTENCES = r"string_split(regexp_replace(text, '([.!?][\s\p{Z}\x1c-\x1f\x{85}]+|[↵\n]+)', '\1' || chr(1), 'g'), chr(1))"


@query(f"""with p as (select doc_id, list_filter({_SENTENCES}, lambda x: x <> '') ps from documents where text is not null), e as (select doc_id, generate_subscripts(ps, 1) i, unnest(ps) x from p), o as (select doc_id, i, length(x) n, sum(length(x)) over (partition by doc_id order by i) e from e), st as (select doc_id, i - 1 sentence, e - n s, e from o),
    {SQL}, g as (select doc_id, s, e, lab from gold) select st.doc_id, st.sentence, count(g.s) filter (where g.s >= st.s and g.e <= st.e) inside, count(g.s) filter (where not (g.s >= st.s and g.e <= st.e)) crossing from st left join g on g.doc_id = st.doc_id and greatest(g.s, st.s) < least(g.e, st.e) group by all""")
def sentence_examples(spark, sf_dir):
    """Sentences with the spans that lie inside them and those that cross their bounds; sentences without any are kept."""
    st = chunking.sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("sentence").cast("long").alias("sentence"), F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))
    met = spans.containment_join(gold(spark, sf_dir), st.withColumnRenamed("sentence", "lab")).groupBy("doc_id", F.col("lab2").alias("sentence")).agg(F.count_if("contained").alias("i"), F.count_if(~F.col("contained")).alias("c"))
    return st.join(met, ["doc_id", "sentence"], "left").select("doc_id", "sentence", F.coalesce("i", F.lit(0)).alias("inside"), F.coalesce("c", F.lit(0)).alias("crossing"))


_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}]'))"
_COUNTED = rf"len(list_filter({_SENTENCES.replace('(text,', '(coalesce(text, {0}),').replace('{0}', chr(39) * 2)}, lambda x: regexp_matches(x, '[^\s\p{{Z}}\x1c-\x1f\x{{85}}↵]')))"
_WHITE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_EXAMPLES = rf"""with p as (select doc_id, list_filter({_SENTENCES}, lambda x: x <> '') ps from documents where text is not null), e as (select doc_id, generate_subscripts(ps, 1) i, unnest(ps) x from p), o0 as (select doc_id, i, x, length(x) n, sum(length(x)) over (partition by doc_id order by i) e from e), st as (select doc_id, i - 1 sentence, x, cast(e - n as int) s, cast(e as int) e from o0), {SQL},
    i0 as (select st.doc_id, sentence, x, g.s - st.s s, g.e - st.s e, lab from st join gold g on g.doc_id = st.doc_id and g.s >= st.s and g.e <= st.e),
    i1 as (select *, substring(x, s + 1, e - s) part from i0),
    i2 as (select distinct doc_id, sentence, x, s + length(regexp_extract(part, '^{_WHITE}*')) s, s + length(regexp_replace(part, '{_WHITE}+$', '')) e, lab from i1),
    i3 as (select *, lead(s) over (partition by doc_id, sentence order by s, e, lab) nx from i2 where s < e),
    k as (select doc_id, sentence, count(*) n, bool_or(coalesce(nx < e, false)) lapped, bool_or((s > 0 and regexp_matches(substring(x, s, 2), '^[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]$')) or regexp_matches(substring(x, e, 2), '^[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]$')) cut, string_agg(s || ' ' || e || ' ' || lab, ',' order by s, e, lab) spans from i3 group by 1, 2),
    r as (select st.doc_id, sentence, g.s, g.e, lab from st join gold g on g.doc_id = st.doc_id and greatest(g.s, st.s) < least(g.e, st.e) and not (g.s >= st.s and g.e <= st.e)),
    c as (select doc_id, sentence, count(*) crossing from r group by 1, 2)"""


@query(f"""{_EXAMPLES} select doc_id, sentence, case when not regexp_matches(x, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]') then 'blank' when {_TOKENS.replace("coalesce(text, '')", "x")} > 512 then 'too long' when coalesce(lapped, false) then 'overlap' when coalesce(cut, false) then 'unaligned' when n > 0 then 'example' else 'negative' end outcome, coalesce(n, 0) n_spans, coalesce(spans, '') spans, coalesce(crossing, 0) crossing
    from st left join k using (doc_id, sentence) left join c using (doc_id, sentence)""")
def sentence_training_examples(spark, sf_dir):
    """Sentences with their spans in their own coordinates, and what becomes of each as an example."""
    found = chunking.sentence_examples(table(spark, sf_dir, "documents"), gold(spark, sf_dir))
    said = F.transform("spans", lambda x: F.concat_ws(" ", x["s"].cast("string"), x["e"].cast("string"), x["lab"].cast("string")))
    return found.select("doc_id", F.col("sentence").cast("long").alias("sentence"), "outcome", F.size("spans").cast("long").alias("n_spans"), F.array_join(said, ",").alias("spans"), "crossing")


@query(f"""{_EXAMPLES}, o as (select doc_id, sentence, case when not regexp_matches(x, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]') then 'blank' when {_TOKENS.replace("coalesce(text, '')", "x")} > 512 then 'too long' when coalesce(lapped, false) then 'overlap' when coalesce(cut, false) then 'unaligned' when n > 0 then 'example' else 'negative' end outcome, coalesce(n, 0) n_spans from st left join k using (doc_id, sentence)),
    a as (select count(*) sentences, {', '.join(f"count(*) filter (where outcome = '{x}') {x.replace(' ', '_')}" for x in ('blank', 'too long', 'overlap', 'unaligned', 'example', 'negative'))}, coalesce(sum(n_spans) filter (where outcome = 'example'), 0)::bigint spans from o),
    b as (select count(*) crossing from (select distinct r.doc_id, r.s, r.e, r.lab from r join o using (doc_id, sentence) where outcome not in ('blank', 'too long'))) select * from a, b""")
def sentence_example_counts(spark, sf_dir):
    """How many sentences became examples, and why others didn't; spans over a sentence's bounds count once for a document."""
    return chunking.example_counts(table(spark, sf_dir, "documents"), gold(spark, sf_dir))


_COUNTS = f"t as (select lang, {_TOKENS} t, {_COUNTED} s from documents), x as (select lang, count(*) documents, cast(sum(t) as bigint) tokens, cast(sum(s) as bigint) sentences, round(avg(t), 4) mean_tokens, round(coalesce(stddev_samp(t), 0), 4) sd_tokens, median(t) median_tokens from t group by lang)"
_KNOWN = """, m as (select d.lang, norm.canonical label, lower(trim(case when trim(text_raw) <> '' then text_raw else norm."text" end)) term from norm join documents d using (doc_id) where note = 'SME1' and canonical is not null),
    k as (select lang, count(*) filter (where not (lang = 'en' and label in ('DX', 'STATUS'))) annotations, count(distinct term) filter (where label = 'AE' and term <> '') ae_terms, count(distinct term) filter (where label in ('SDRUG', 'CDRUG') and term <> '') drug_terms from m group by lang)"""
_STATS = f"with {ANNOTATION_SQL}, {_COUNTS}{_KNOWN}, z as (select x.*, coalesce(annotations, 0) annotations, coalesce(ae_terms, 0) ae_terms, coalesce(drug_terms, 0) drug_terms from x left join k on k.lang is not distinct from x.lang)"


@query(f"{_STATS} select * from z")
def corpus_stats(spark, sf_dir):
    """Tokens and sentences of each language's documents, and what one annotator found in them: in English two labels don't count."""
    documents = table(spark, sf_dir, "documents")
    known = annotations(spark, sf_dir).where("note = 'SME1'").join(documents.select("doc_id"), "doc_id", "left_semi")
    rows = L.normalized(known, taxonomy(spark)).where("canonical is not null")
    found = rows.select("doc_id", F.col("canonical").alias("label"), L.terms(rows).alias("term"))
    return corpus.with_annotations(corpus.statistics(documents, ["lang"]), documents, found, "lang", left_out={"en": ["DX", "STATUS"]}, ae=["AE"], drug=["SDRUG", "CDRUG"])


_ROWS = {"reports": "documents", "tokens": "tokens", "sentences": "sentences", "mean_tokens": "mean_tokens", "sd_tokens": "sd_tokens", "median_tokens": "median_tokens", "annotations": "annotations", "ae_terms": "ae_terms", "drug_terms": "drug_terms"}


@query(f"{_STATS}, y as (select coalesce(lang, '') corpus, {', '.join(f'cast({c} as double) {n}' for n, c in _ROWS.items() if n != c)}, {', '.join(f'cast({c} as double) {c}_' for n, c in _ROWS.items() if n == c)} from z), w as (select corpus, reports, {', '.join(f'{n}_ {n}' for n, c in _ROWS.items() if n == c)} from y) unpivot w on {', '.join(_ROWS)} into name metric value \"value\"")
def report_corpus(spark, sf_dir):
    """Each corpus's statistics as rows of a table."""
    wide = corpus_stats(spark, sf_dir).select(F.coalesce("lang", F.lit("")).alias("corpus"), *(F.col(c).cast("double").alias(n) for n, c in _ROWS.items()))
    return wide.unpivot("corpus", list(_ROWS), "metric", "value")
