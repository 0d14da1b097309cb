"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read

VOCABULARY = "byte_bpe_50k.json"
Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_lines

    kept = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import apply_rules

    return apply_rules(read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_texts

    return score_texts(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link_documents

    return link_documents(read(spark, sf_dir, "documents"), size=3, percent=90)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_contamination

    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import label_languages, train

    documents = read(spark, sf_dir, "documents")
    model = train(documents.where(crc_mod("doc_id", 4) != 2))
    return label_languages(documents, model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    sha = lambda x: F.sha2(x.cast("binary"), 256)
    cut = fill_in_middle(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import align_tokens

    return align_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    documents = read(spark, sf_dir, "documents")
    return read_tokens(write_tokens(documents, tokenizer_path("word_bpe_49k.json")), documents.schema["doc_id"].dataType.simpleString())


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_alignment": op12_token_alignment,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    # Words inside a window of 35 that starts at two places or more go.
    "op4_substring_dedup": r"""
        with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents),
        g as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) g from (select doc_id, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
        r as (select distinct doc_id, unnest(range(i, i + 35)) p from (select doc_id, i, count(*) over (partition by g) c from g) where c > 1),
        p as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from d),
        k as (select p.doc_id, string_agg(p.word, ' ' order by p.p) filter (where r.p is null) kept, count(r.p) n from p left join r on p.doc_id = r.doc_id and p.p = r.p group by p.doc_id)
        select d.doc_id, cast(len(w) as bigint) n_words, coalesce(k.n, 0) n_removed, sha256(coalesce(k.kept, '')) kept_sha256 from d left join k using (doc_id)""",
    # Lines of at least 20 code points in three documents or more stay in the largest of these alone.
    "op5_line_dedup": r"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
        k as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l),
        r as (select k, max(doc_id) keeper from k where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
        m as (select k.doc_id, k.line, k.i, r.keeper is not null and r.keeper <> k.doc_id gone from k left join r using (k))
        select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped,
          sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
        from m group by doc_id""",
    # Lines in more than 20 and in more than 0.5 % of a host's distinct texts go; depleted documents are not kept.
    "op6_quality_rules": r"""
        with d as (select doc_id, coalesce(source, '') host, coalesce(text, '') text, text raw,
            list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents),
        g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)),
        r as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 5)) p from (select *, count(*) over (partition by doc_id, g) c from g) where c > 1) group by doc_id),
        l as (select doc_id, host, raw, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))), lambda x: x <> '')) line from d),
        n as (select *, regexp_replace(lower(line), '[ \t\n\x0B\f\r]+', ' ', 'g') k, len(string_split_regex(line, '[ \t\n\x0B\f\r]+')) n from l),
        f as (select host, k from n join (select host, count(distinct raw) + max(case when raw is null then 1 else 0 end) a from d group by host) using (host)
            group by host, k, a having count(distinct raw) > 20 and count(distinct raw) > 0.005 * a),
        x as (select doc_id, sum(n) n from n join f using (host, k) group by doc_id),
        m as (select d.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols,
            len(list_filter(string_split(text, chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) <> '')) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) <> ''))) n_dup_lines,
            coalesce(r.n, 0) n_repeat_words, len(w) - coalesce(x.n, 0) n_left
          from d left join r using (doc_id) left join x using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left,
          n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
          not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_left >= 10 and n_left >= 0.3 * n_words kept
        from m""",
    "op9_decontamination": r"""
        with d as (select doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
        b as (select item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where text is not null),
        g as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') g from (select item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
        sizes as (select distinct n from g),
        dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
        h as (select dw.doc_id, dw.i, dw.n, g.item_id from dw join g on dw.g = g.g and dw.n = g.n),
        c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from h) group by doc_id),
        t as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, cast(item_id as varchar) item_id from h) group by doc_id)
        select d.doc_id, cast(coalesce(len(d.w), 0) as bigint) n_words, coalesce(c.n_hit, 0) n_hit, coalesce(t.n_items, 0) n_items,
          sha256(coalesce(t.ids, '')) items_sha256, coalesce(c.n_hit, 0) > 0 contaminated
        from d left join c using (doc_id) left join t using (doc_id)""",
    # Lines drawn by the id's hash; the restored text is the document's.
    "op11_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') t, sha256(concat('7:', doc_id)) x from documents),
        h as (select doc_id, t, string_split(t, chr(10)) u, ('0x' || x[1:8])::bigint h1, ('0x' || x[9:16])::bigint h2, ('0x' || x[17:24])::bigint h3, ('0x' || x[25:32])::bigint h4 from d),
        n as (select *, len(u) - cast(u[-1] = '' as int) n from h),
        k as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
          case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from n),
        p as (select *, case when a = n then t when a = 0 then '' else concat(array_to_string(u[1:a], chr(10)), chr(10)) end p,
          case when b = n then t when b = 0 then '' else concat(array_to_string(u[1:b], chr(10)), chr(10)) end pm from k),
        c as (select *, substr(pm, length(p) + 1) m, substr(t, length(pm) + 1) s from p)
        select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
          sha256(case form when 'plain' then t when 'psm' then concat('<P>', p, '<S>', s, '<M>', m) else concat('<S>', s, '<P>', p, '<M>', m) end) output_sha256,
          sha256(t) restored_sha256
        from c""",
}
