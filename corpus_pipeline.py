"""The corpus pipeline: each stage works on all that the one before kept.

Rows are told apart by themselves: each is judged by its own text, whatever id it
has. Of a group of near duplicates one row stays, of the smallest id; rows of a
null id have none and pass that stage and the line stage. Stages that change a text
set ``n_chars`` anew, where there is such a column of whole numbers; all other
columns pass through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import read, written
from glosswork.llm.decontamination import remove_contamination
from glosswork.llm.jaccard_join import one_of_each
from glosswork.llm.line_dedup import drop_lines
from glosswork.llm.packing import pack_documents
from glosswork.llm.quality import keep_quality
from glosswork.llm.queries import tokenizer_path

#: Documents below this score are rejected.
LEAST_SCORE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on docs and their labels, doesn't reject."""
    return keep_quality(docs, read(spark, sf_dir, "labels"), least=LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that three or more share, but in their last; a document that loses all keeps an empty text."""
    return _measured(drop_lines(docs, counts=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group that links of five-word shingles at 0.8 reach."""
    return one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less every word inside a benchmark window."""
    return _measured(remove_contamination(docs, read(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]
#: No SQL: a learned classifier decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
