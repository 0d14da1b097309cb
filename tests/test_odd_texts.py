"""Anchoring queries against their SQL on texts that are short or repeat themselves."""

import duckdb
import pytest

from glosswork.operators.drift import equal_stretches, longest_common
from glosswork.plans.catalog import ORACLE_SQL, QUERIES

TURNS = ["To ed he of.", "The the the the ening rely lyinen", "abcdeabcdeabcdeabc", "aaaaaaaaaaaaaaa", "cdefgcdefgxcdefg", "To", "", "Nothing is said twice here, or so it seems."]
DOCUMENTS = ["ERTION,!! TIOUEN!! REORED!! ANOR!! " * 40, "ab" * 300, "THE!! " * 9 + "END", "Plain words that do not come again."]


def same(spark, folder, name):
    con = duckdb.connect()
    for path in folder.iterdir():
        con.execute(f"create view {path.stem} as select * from '{path}'")
    found = QUERIES[name](spark, str(folder))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"select {', '.join(found.columns)} from ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["anchor_json_entities", "json_offset_spans"])
def test_turns(spark, tmp_path, name):
    duckdb.connect().execute("copy (select 1::bigint conv_id, unnest(range(len($1)))::bigint turn, unnest($1) text) to '" + str(tmp_path / "conversations.parquet") + "' (format parquet)", [TURNS])
    same(spark, tmp_path, name)


def test_tags_of_repeating_texts_stand_where_they_stood(spark, tmp_path):
    duckdb.connect().execute("copy (select unnest(range(len($1)))::bigint * 12 doc_id, unnest($1) text) to '" + str(tmp_path / "documents.parquet") + "' (format parquet)", [DOCUMENTS])
    same(spark, tmp_path, "anchor_tag_spans")


def test_stretches_of_a_text_that_repeats_itself():
    text = "PERIOD of words, " * 5
    assert longest_common("xx" + text[:40] + "yy", text, 12) == (2, 0, 40)
    assert longest_common("abc", "abd", 3) is None
    copy = "before " + text[:50] + "__" + text[50:] + " after"
    found = equal_stretches(copy, text)
    assert all(copy[i : i + n] == text[j : j + n] and n >= 12 for i, j, n in found)
    assert all(i + n <= i2 and j + n <= j2 for (i, j, n), (i2, j2, _) in zip(found, found[1:], strict=False))
