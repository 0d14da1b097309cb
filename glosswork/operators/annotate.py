"""Documents annotated by a caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotate_documents(documents: DataFrame, annotate: Callable[[str], list[dict]]) -> DataFrame:
    """doc_id, status (ok or error), spans (s, e, lab), error: annotate over each text; what it raises is a row, not a failure of the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                try:
                    rows.append((doc_id, "ok", annotate(text or ""), None))
                except Exception as e:  # the caller's function may fail in any way
                    rows.append((doc_id, "error", [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "status", "spans", "error"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, status string, spans array<struct<s:int,e:int,lab:string>>, error string")
