"""Quality rules with cross-document line frequency, in DataFrame operations alone.

A text's own rules: at least ``min_words`` words, and at most ``max_repeat`` per
cent of them in five-word windows that occur twice in it. Across documents:
lines are normalised (lower case, single blanks) and hashed, and for each host
the distinct documents of each line are counted, copies of a text once. Lines
in more than ``host_share`` of a host's documents, and in more than
``host_docs``, go; a document that keeps fewer than ``min_words`` words, or less
than ``min_left`` of them, is depleted and rejected.

Counts go by (host, line) after a partial aggregation, so a line that a third
of all rows hold is one row a task; texts are never shuffled. Defined results:
null text has no words and fails the base rules; a null host counts as the
empty one; rows may repeat; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
_SPACE_CLASS = r"[ \t\n\x0B\f\r]+"
WINDOW = 5


def split_words(text: Column) -> Column:
    """The words of a text, an empty array for null or blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, _SPACE_CLASS)).otherwise(F.array().cast("array<string>"))


def _pairs(values: Column, pair) -> Column:
    """pair(a, b) for each two neighbours of an array of two elements or more."""
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), pair)


def window_hashes(words: Column) -> Column:
    """A hash of each five-word window; words must be a column, not an expression."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def with_repeated_words(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """df with name: the words inside a window whose hash is twice or more in the array column hashes (all windows, in order).

    Each step is a column of its own, as a step that is used twice must not be worked out twice.
    """
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    some = lambda values, out: F.when(F.size(values) > 1, out)
    both = _pairs(F.col("_placed"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_starts", some(F.col("_placed"), F.sort_array(F.array_distinct(F.flatten(both)))))
    # A window adds the words up to the next one's start, five at most; the last adds five.
    covered = F.aggregate(_pairs(F.col("_starts"), lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(WINDOW), lambda x, y: x + y)
    return df.withColumn(name, F.coalesce(some(F.col("_starts"), covered), F.lit(0)).cast("long")).drop("_placed", "_starts")


def normalised_lines(text: Column) -> Column:
    """hash and number of words of each line that has a word."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    word_lines = F.filter(bare, lambda x: F.length(x) > 0)
    return F.transform(word_lines, lambda x: F.struct(F.xxhash64(F.regexp_replace(F.lower(x), _SPACE_CLASS, " ")).alias("hash"), F.size(F.split(x, _SPACE_CLASS)).alias("n")))


def base_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    column = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_words", split_words(column)).withColumn("_hashes", window_hashes(F.col("_words")))
    with_word = F.filter(F.split(column, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return with_repeated_words(out, "_hashes", "n_repeat_words").withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(column) - F.length(F.regexp_replace(column, r"[#*$%&|<>]", ""))).cast("long"),
        "_lines": with_word,
    }).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_words", "_hashes", "_lines")


def frequent_lines(df: DataFrame, *, text: str = "text", host: str = "source", host_share: float = 0.005, host_docs: int = 20) -> DataFrame:
    """(_host, _hash): lines in more of a host's distinct texts than both limits allow."""
    rows = df.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.xxhash64(text).alias("_text"), F.explode(F.array_distinct(F.transform(normalised_lines(F.col(text)), lambda x: x["hash"]))).alias("_hash"))
    counts = rows.distinct().groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > host_docs)
    hosts = df.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.xxhash64(text).alias("_text")).distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    return counts.join(hosts, "_host").where(F.col("_docs") > host_share * F.col("_all")).select("_host", "_hash")


def apply_rules(df: DataFrame, *, text: str = "text", host: str = "source", min_words: int = 10, max_repeat: int = 20, host_share: float = 0.005, host_docs: int = 20, min_left: float = 0.3) -> DataFrame:
    """doc_id, the base measures, base_failed, n_left (words outside frequent lines) and kept for each row of df."""
    frequent = frequent_lines(df, text=text, host=host, host_share=host_share, host_docs=host_docs)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(text).alias("_t"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = base_measures(rows, "_t").select("_row", "_host", *names, F.explode_outer(normalised_lines(F.col("_t"))).alias("_line"))
    lines = measured.select("_row", *names, "_host", F.col("_line.hash").alias("_hash"), F.col("_line.n").alias("_n"))
    found = lines.join(frequent.withColumn("_gone", F.lit(True)), ["_host", "_hash"], "left")
    out = found.groupBy("_row").agg(*(F.first(x).alias(x) for x in names), F.coalesce(F.sum(F.when(F.col("_gone"), F.col("_n"))), F.lit(0)).alias("_removed"))
    n, left = F.col("n_words"), F.col("n_words") - F.col("_removed")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat * n)
    return out.select(*names, failed.alias("base_failed"), left.alias("n_left"), (~failed & (left >= min_words) & (left >= min_left * n)).alias("kept"))
