"""What must not grow with the tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glosswork.operators import anchoring
from glosswork.plans import score_queries
from glosswork.plans.catalog import QUERIES


def test_logs_are_not_a_file_each(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(score_queries, "new_folder", lambda *_: str(tmp_path / "logs"))
    found = {r["model"]: r["runs"] for r in QUERIES["report_encoder_ablation"](spark, sf_dir).collect()}
    assert len(list(Path(tmp_path / "logs").rglob("*.txt"))) < sum(found.values())


@pytest.mark.parametrize("most", [1, 7])
def test_texts_leave_a_task_in_small_batches(spark, monkeypatch, most):
    monkeypatch.setattr(anchoring, "TEXTS", most)
    seen, parsed = [], anchoring.parsed_tags
    texts = spark.range(20, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a <AE>b</AE> "), F.col("id").cast("string")).alias("text"))
    seen = parsed(texts, {"AE": "ADVERSE"}).mapInArrow(lambda batches: batches, "doc_id long, clean string, spans array<struct<s:int,e:int,lab:string>>, warnings array<string>").collect()
    assert [(r["doc_id"], r["clean"]) for r in sorted(seen)] == [(i, f"a b {i}") for i in range(20)]


@pytest.mark.parametrize("name", ["per_category_metrics_directional", "report_case_series", "pool_by_seed_complete"])
def test_spans_are_aligned_once(spark, sf_dir, monkeypatch, name):
    made = []
    monkeypatch.setattr(score_queries, "stored", lambda df, _: made.append(df) or df.localCheckpoint())
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + len(made) == 1
