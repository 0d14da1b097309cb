"""Text columns. All return null for null unless they say otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as Unicode has them (Java's own classes are ASCII).
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
SEPARATOR = rf"((?<=[.!?])[{SPACE}]+|[↵\n]+)"
_MARK = "\u0001"


def n_tokens(text: Column) -> Column:
    """Words (letters, digits, underscores) and single other marks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def sentence_pieces(text: Column) -> Column:
    """The sentences, each with the white space that closes it: joined they are the text."""
    return F.filter(F.split(F.regexp_replace(text, SEPARATOR, f"$1{_MARK}"), _MARK), lambda x: x != "")


def n_sentences(text: Column) -> Column:
    """Sentences that hold more than white space; 0 for null."""
    return F.coalesce(F.size(F.filter(sentence_pieces(text), lambda x: x.rlike(rf"[^{SPACE}↵]"))), F.lit(0)).cast("long")


def normalized_term(raw: Column, shown: Column) -> Column:
    """The raw term if it isn't blank, else the one shown; trimmed, lower case."""
    return F.lower(F.trim(F.coalesce(F.when(F.trim(raw) != "", raw), shown)))


def single_spaced(text: Column) -> Column:
    """Lower case, each run of white space one blank."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[{SPACE}]+", " "))


def clean_punct(text: Column) -> Column:
    """Without white space and ASCII punctuation at both ends, lower case; empty for null."""
    bare = lambda x: F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    return F.lower(bare(F.regexp_replace(bare(F.coalesce(text, F.lit(""))), r"^\p{Punct}+|\p{Punct}+\z", "")))


def contain_each_other(a: Column, b: Column) -> Column:
    """Whether either, trimmed and in lower case, holds the other; not for empty ones."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & ((F.instr(x, y) > 0) | (F.instr(y, x) > 0))


def printable(text: Column) -> Column:
    """Without control characters and separators other than the blank."""
    return F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", "")


#: A numbered heading (a fixed value of the semantics).
HEADING = r"(?=\b(\d+\.\d+ [A-Z][a-z]+(?: [A-Z][a-z]+)*|\d+ [A-Z\s]+)\b)"


def marked_sections(text: Column) -> Column:
    """A heading element before each numbered heading, which stays where it is."""
    return F.regexp_replace(text, HEADING, "<h3>$1</h3>")


def without_tags(html: Column) -> Column:
    """Tags as blanks, runs of white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: a lambda that names it would do so at each step."""
    return F.transform(F.array(value), use)[0]


def sums_before(numbers: Column, levels: int = 2) -> Column:
    """For each number the sum of those before it.

    A fold that appends copies what it has; so short runs (of the cube root of the length,
    with two levels) are folded, and each is moved by the sum of the runs before it, which are
    summed in the same way.
    """
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    fold = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")))
    if not levels:
        return fold(numbers)["out"]

    def in_runs(xs: Column, run: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / run).cast("int") - 1, F.lit(0)))
        return F.transform(starts, lambda k: fold(F.slice(xs, k * run + 1, run)))

    def moved(runs: Column) -> Column:
        before = sums_before(F.transform(runs, lambda r: r["sum"]), levels - 1)
        return F.flatten(F.zip_with(runs, before, lambda r, b: F.transform(r["out"], lambda x: x + b)))

    length = lambda xs: F.greatest(F.ceil(F.pow(F.size(xs), F.lit(1 / (levels + 1)))).cast("int"), F.lit(1))
    return let(numbers, lambda xs: let(length(xs), lambda run: let(in_runs(xs, run), moved)))


def tag_free_places(html: Column) -> Column:
    """The places (from 0) of the characters outside tags, in order."""
    def outside(parts: Column) -> Column:
        tag = lambda x: F.startswith(x, F.lit("<")) & F.endswith(x, F.lit(">"))
        places = lambda x, at: F.when(tag(x), F.array().cast("array<int>")).otherwise(F.sequence(at, at + F.length(x) - 1))
        return F.flatten(F.zip_with(parts, sums_before(F.transform(parts, F.length)), places))

    return let(F.regexp_extract_all(html, F.lit(r"<[^>]*>|[^<]+|<"), F.lit(0)), outside)


def sanitized(output: Column) -> Column:
    """A model's output without byte-order marks, one code fence around it and a known opening line."""
    text = F.replace(output, F.lit("﻿"), F.lit(""))
    text = F.regexp_replace(text, r"^\s*```(?i:xml|html|text)?\s*\n?", "")
    text = F.regexp_replace(text, r"\n?\s*```\s*\z", "")
    return F.regexp_replace(text, r"^(?i)\s*The annotated text is shown as below:\s*(?:\r?\n)?", "")


def occurrences(text: Column, term: Column) -> Column:
    """How often the term stands in the text, without overlaps, whatever the case; 0 for an empty term."""
    low = F.lower(text)
    return F.when(F.length(term) > 0, ((F.length(low) - F.length(F.replace(low, F.lower(term), F.lit("")))) / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def exact_occurrences(text: Column, term: Column) -> Column:
    """All places (from 0) where the term stands, overlaps included; none for an empty term."""
    # The text is parted before each occurrence, and the parts' lengths are summed up: linear in the text.
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    places = sums_before(F.transform(F.split(text, quoted), F.length))
    found = let(places, lambda all: F.when(F.startswith(text, term), all).otherwise(F.slice(all, F.lit(2), F.greatest(F.size(all) - 1, F.lit(0)))))
    return F.when(F.length(term) > 0, found).when(F.length(term) == 0, F.array().cast("array<int>"))


def nearest_occurrence(text: Column, term: Column, expected: Column, window: int = 800) -> Column:
    """The place nearest to the expected one, at most so far from it, the first of two as near; null without any."""
    low = F.greatest(expected - window, F.lit(0))
    high = F.least(expected + window + F.length(term), F.length(text))
    near = exact_occurrences(F.substring(text, low + 1, F.greatest(high - low, F.lit(0))), term)
    best = F.array_min(F.transform(near, lambda i: F.struct(F.abs(i + low - expected).alias("d"), (i + low).alias("at"))))
    return best["at"]


def case_identifiers(name: Column) -> tuple[Column, Column]:
    """Case and version of a file name, '0' and '1' where it has none."""
    bare = F.regexp_replace(name, r"\.json$", "")
    both = bare.rlike(r"^(.+)-(.+)$")
    return F.when(both, F.regexp_extract(bare, r"^(.+)-(.+)$", 1)).otherwise("0"), F.when(both, F.regexp_extract(bare, r"^(.+)-(.+)$", 2)).otherwise("1")


def case_number(value: Column, blank: str = "0") -> Column:
    """A number without decimals where it is one, else as it is; blank where it is blank."""
    text = F.trim(value)
    return F.when(F.coalesce(text, F.lit("")) == "", blank).otherwise(F.coalesce(text.try_cast("double").cast("long").cast("string"), text))


def ranked_items(text: Column) -> Column:
    """``1) foo; 2) bar`` as structs (rank, text); a rank is null where there is none."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    ranked = r"^(\d+)\)\s*(.*)$"
    return F.transform(items, lambda x: F.struct(F.when(x.rlike(ranked), F.regexp_extract(x, ranked, 1)).cast("int").alias("rank"), F.when(x.rlike(ranked), F.trim(F.regexp_extract(x, ranked, 2))).otherwise(x).alias("text")))


def history_items(text: Column) -> Column:
    """Items between semicolons, without blanks and closing brackets at their ends."""
    return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), lambda x: F.btrim(x, F.lit(" ;)")))


def json_object(text: Column) -> Column:
    """The text as a JSON object, or what stands from its first to its last brace; null where neither parses."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(text), valid(inner))


def json_patched(meta: Column, changes: dict[str, Column]) -> Column:
    """A JSON map of strings with keys set anew."""
    old = F.from_json(F.coalesce(meta, F.lit("{}")), "map<string,string>")
    new = F.create_map(*(x for k, v in changes.items() for x in (F.lit(k), v)))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*changes)), new))


def status_code(started: Column, done: Column, count: Column) -> Column:
    """-2 never started, -1 at work, else the count."""
    return F.when(~F.coalesce(started, F.lit(False)), -2).when(~F.coalesce(done, F.lit(False)), -1).otherwise(count)


def percent_text(mean: Column, sd: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, sd)
