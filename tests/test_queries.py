"""Each registered annotation query against its SQL: at the smallest size, or at TEST_SF; some at a larger one too, where ties and half values come up."""

import os
from pathlib import Path

import duckdb
import pytest

from glosswork.plans.catalog import ORACLE_SQL, QUERIES

SIZES = [(name, os.environ.get("TEST_SF", "0.001")) for name in sorted(ORACLE_SQL)]
SIZES += [(name, "0.01") for name in ("bootstrap_ci", "corpus_stats", "demographic_entries", "label_summary_over_folds", "stream_annotation_events")]


@pytest.fixture(scope="module")
def duck():
    held = {}

    def connection(folder):
        if folder not in held:
            held[folder] = duckdb.connect()
            for path in Path(folder).glob("*.parquet"):
                held[folder].execute(f"create view {path.stem} as select * from '{path}'")
        return held[folder]

    return connection


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize(("name", "size"), SIZES)
def test_query_equals_its_sql(spark, duck, name, size):
    folder = f"/root/testdata/sf{size}"
    df = QUERIES[name](spark, folder)
    oracle = duck(folder).execute(ORACLE_SQL[name])
    columns = [c[0] for c in oracle.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, oracle.fetchall())
