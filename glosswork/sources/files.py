"""Scans of document JSON, prediction caches, run tables, manifests, logs and case exports, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = "struct<page:int,start:int,`end`:int,text:string>"
DOCUMENT = f"pages array<string>, annotations array<struct<label:string,note:string,textContext:{SPAN},relationships:map<string,{SPAN}>,disputed:boolean,adjudication:string>>, meta string"
PREDICTION = "status string, document string, predicted_entities array<struct<start:int,`end`:int,label:string,text:string>>, error string, number long, _broken string"
OUTCOME = ("doc_id", "match_type", "subtype", "gold_s", "gold_e", "gold_lab", "pred_s", "pred_e", "pred_lab")


def documents(spark: SparkSession, path: str, *, note: str = "SME1") -> DataFrame:
    """file, text (the first page), annotations (those with the note) of each document JSON below path."""
    rows = spark.read.schema(DOCUMENT).json(path).select(F.col("_metadata.file_name").alias("file"), "*")
    return rows.select("file", "meta", F.get("pages", F.lit(0)).alias("text"), F.filter("annotations", lambda a: a["note"] == note).alias("annotations"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """The texts alone: annotations are never read."""
    return spark.read.schema("pages array<string>, meta string").json(path).select("meta", F.get("pages", F.lit(0)).alias("text"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """The good record of the largest number of each document; blank and broken lines are left out."""
    rows = spark.read.schema(PREDICTION).option("columnNameOfCorruptRecord", "_broken").json(path)
    good = rows.where("_broken is null and status = 'ok' and document is not null")
    return good.groupBy("document").agg(F.max_by(F.struct("predicted_entities", "number"), "number").alias("_x")).select("document", "_x.predicted_entities", "_x.number")


def checked(df: DataFrame, columns: tuple[str, ...] = OUTCOME, domain: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """df, whose columns are known to be there; rows with a value outside its domain stop the job that reads them."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    for column, values in (domain or {"match_type": ("M", "C", "S", "N")}).items():
        bad = F.raise_error(F.concat(F.lit(f"{column} is none of {', '.join(values)}: "), F.coalesce(F.col(column), F.lit("null"))))
        df = df.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise(bad))
    return df


def run_files(spark: SparkSession, path: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of runs in folders fold=/seed=, and what is missing of the expected (fold, seed)."""
    rows = spark.read.parquet(path)
    return rows, expected.join(rows.select("fold", "seed").distinct(), ["fold", "seed"], "left_anti")


RUN_NAME = r"fold_(\d+)_seed_(\d+)_raw"


def nonempty(df: DataFrame, what: str) -> DataFrame:
    """df; an error where it has no rows."""
    if df.isEmpty():
        raise ValueError(f"there are no {what}")
    return df


def named_runs(spark: SparkSession, path: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of runs in folders run=fold_XX_seed_Y_raw, with fold and seed from the name, and what is wrong with them.

    Problems (problem, fold, seed, n): runs that are missing of the expected (fold, seed),
    or not expected; a run of several folders (duplicate, n folders); rows (n) whose own own_fold and own_seed
    are other than the name's (disagrees); folders (n) without a run in their name (unnamed).
    """
    rows = spark.read.parquet(path)
    part = lambda k: F.regexp_extract("run", RUN_NAME, k).try_cast("int")
    rows = rows.withColumns({"fold": part(1), "seed": part(2)})
    # A row for each folder.
    folders = rows.groupBy("run", "fold", "seed").agg(F.count_if(~(F.col("own_fold").eqNullSafe(F.col("fold")) & F.col("own_seed").eqNullSafe(F.col("seed")))).alias("other"))
    keys, known = ["fold", "seed"], F.col("fold").isNotNull()
    # A row for each run, and one for all folders without.
    actual = folders.groupBy("fold", F.when(known, F.col("seed")).alias("seed")).agg(F.count(F.lit(1)).alias("folders"), F.sum("other").alias("other"))
    both = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("wanted")).join(actual, keys, "full")
    problem = lambda name, n: F.struct(F.lit(name).alias("problem"), n.cast("long").alias("n"))
    here, one = F.col("folders").isNotNull(), F.lit(1)
    found = F.array_compact(F.array(
        F.when(here & ~known, problem("unnamed", F.col("folders"))), F.when(here & known & F.col("wanted").isNull(), problem("unexpected", one)),
        F.when(known & (F.col("folders") > 1), problem("duplicate", F.col("folders"))), F.when(known & (F.col("other") > 0), problem("disagrees", F.col("other"))),
    ))
    missing = F.array_repeat(problem("missing", one), F.when(here, 0).otherwise(F.col("wanted")).cast("int"))
    problems = both.select(*keys, F.explode(F.concat(missing, found)).alias("x")).select("x.problem", *keys, "x.n")
    return rows, problems


def manifest_folds(df: DataFrame, column: str) -> DataFrame:
    """fold, doc_id of a manifest's map from fold to files, without their ending."""
    folds = df.select(F.explode(F.from_json(F.get_json_object(column, "$.fold_documents"), "map<string,array<string>>")).alias("fold", "files"))
    return folds.select(F.col("fold").cast("int").alias("fold"), F.explode("files").alias("file")).select("fold", F.regexp_replace("file", r"\.json$", "").alias("doc_id"))


def train_log(df: DataFrame, *keys: str) -> DataFrame:
    """keys of df, epoch, step, loss_trans, loss_ner, f, p, r, score of the lines (value) that are rows of a log; ents_* come in per cent."""
    x = F.split(F.trim("value"), r"\s+")
    names = ("epoch", "step", "loss_trans", "loss_ner", "f", "p", "r", "score")
    numbers = [F.get(x, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)]
    rows = df.where(F.size(x) >= 8).select(*keys, *numbers).dropna(subset=list(names))
    return rows.withColumns({n: F.col(n) / 100 for n in "fpr"} | {n: F.col(n).cast("long") for n in ("epoch", "step")})


def case_table(cells: DataFrame, keys: tuple[str, ...] = ("case number", "case id"), rows_searched: int = 20) -> DataFrame:
    """case_number, cells of the rows below the header of sheet rows (row_no, cells): the first of the first rows that holds a key."""
    norm = lambda c: F.lower(F.trim(c))
    holds = F.exists("cells", lambda x: norm(x).isin(*keys))
    header = cells.where(F.col("row_no") < rows_searched).where(holds).orderBy("row_no").limit(1)
    at = header.select(F.col("row_no").alias("_header"), F.array_max(F.transform("cells", lambda x, i: F.when(norm(x).isin(*keys), i).otherwise(-1))).alias("_at"))
    rows = cells.join(F.broadcast(at), F.col("row_no") > F.col("_header"))
    return rows.select(F.coalesce(F.trim(F.get("cells", F.col("_at"))), F.lit("")).alias("case_number"), F.transform("cells", lambda x: F.coalesce(x, F.lit(""))).alias("cells"))


def intake(df: DataFrame, column: str) -> DataFrame:
    """case, label, s, e, note of the annotations of posted cases (JSON), whatever of their field names they use."""
    one = "struct<label:string,type:string,start:int,`end`:int,textContext:struct<start:int,`end`:int>,role_name:string,note:string>"
    rows = df.select(F.from_json(column, f"struct<`case`:string,annotations:array<{one}>>").alias("c")).select("c.case", F.explode("c.annotations").alias("a"))
    some = lambda *names: F.coalesce(*(F.when(F.trim(F.col(f"a.{n}")) != "", F.col(f"a.{n}")) for n in names))
    return rows.select(
        "case", F.coalesce(some("label", "type"), F.lit("UNKNOWN")).alias("label"), F.coalesce("a.start", "a.textContext.start").alias("s"), F.coalesce(F.col("a.end"), F.col("a.textContext.end")).alias("e"),
        F.coalesce(some("role_name", "note"), F.lit("Admin")).alias("note"),
    )


def write_runs(df: DataFrame, path: str) -> None:
    """A table of runs in folders by fold and seed; a run of many rows is written by many tasks."""
    df.hint("rebalance", "fold", "seed").write.partitionBy("fold", "seed").parquet(path)


def missing_entities(outcomes: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, s, e, label, text of the spans that were missed, and full_text, the text of their document."""
    rows = outcomes.where("match_type = 'N'").join(texts, "doc_id")
    return rows.select("doc_id", F.col("gold_s").alias("s"), F.col("gold_e").alias("e"), F.col("gold_lab").alias("label"), F.substring("text", F.col("gold_s") + 1, F.col("gold_e") - F.col("gold_s")).alias("text"), F.col("text").alias("full_text"))


def run_metadata(outcomes: DataFrame, prompt: str) -> DataFrame:
    """One row: a run's counts and the hash of its prompt, as JSON."""
    counts = {x: F.count_if(F.col("match_type") == x).alias(x) for x in "MCSN"}
    return outcomes.agg(F.to_json(F.struct(F.count_distinct("doc_id").alias("documents"), *counts.values(), F.lit(prompt).alias("prompt"))).alias("_json")).select(F.to_json(F.struct(F.from_json("_json", "documents long, M long, C long, S long, N long").alias("counts"), F.sha2(F.lit(prompt).cast("binary"), 256).alias("prompt_sha256"))).alias("metadata"))


def last_lines(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
