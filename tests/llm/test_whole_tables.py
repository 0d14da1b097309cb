"""Queries on whole tables: against their SQL, or by held-out accuracy."""

from pathlib import Path

import duckdb
import pytest

from glosswork.llm.common import read
from glosswork.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    oracle = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in oracle.description]
    found = QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(oracle.fetchall(), key=repr)


def test_language_accuracy_on_held_out_documents(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in read(spark, sf_dir, "documents").collect()}
    rows = [r for r in QUERIES["op10_language_id"](spark, sf_dir).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert len(rows) > 20 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def test_quality_accuracy_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in read(spark, sf_dir, "labels").collect()}
    rows = [r for r in QUERIES["op2_quality_classifier"](spark, sf_dir).collect() if r["held_out"] and quality.get(r["doc_id"]) is not None]
    assert all(0 <= r["score"] <= 1 for r in rows)
    right = sum(r["predicted"] == quality[r["doc_id"]] for r in rows)
    assert len(rows) > 50 and right >= 0.85 * len(rows), (right, len(rows))


def test_language_model_beats_word_counts_on_held_out_documents(spark):
    rows = [r for r in QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(rows) > 50
    score, base = (sum(r[name] for r in rows) for name in ("score", "base_score"))
    assert score > base, (score, base)


def test_language_model_beats_word_counts_at_the_larger_size(spark):
    rows = [r for r in QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    score, base = (sum(r[name] for r in rows) for name in ("score", "base_score"))
    assert len(rows) > 500 and score > base, (score, base)
