"""Defined results of scans, examples, and functions of SQL."""

import pytest

from glosswork.functions import register
from glosswork.functions.udtfs import register_tables
from glosswork.operators import chunking, labels
from glosswork.sources import files


def test_a_corpus_without_documents_is_an_error(spark):
    with pytest.raises(ValueError, match="no documents"):
        files.nonempty(spark.range(0), "documents")
    assert files.nonempty(spark.range(2), "documents").count() == 2


def test_sentences_as_examples(spark):
    docs = spark.createDataFrame([(1, "One word. Two words here. \n  \nThree more words."), (2, "w " * 600 + ". End."), (3, None), (4, ""), (5, "x\n \ny")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 3, "a"), (1, 10, 14, "b"), (1, 10, 13, "b"), (1, 7, 12, "x"), (1, 32, 36, "c"), (2, 0, 1, "a"), (9, 0, 1, "a")], "doc_id long, s int, e int, lab string")
    found = {(r.doc_id, r.sentence): r for r in chunking.sentence_examples(docs, spans).collect()}
    assert [found[1, i].outcome for i in range(3)] == ["example", "example", "unaligned"] and [found[5, i].outcome for i in range(3)] == ["negative", "blank", "negative"] and found[2, 0].outcome == "too long" and found[2, 1].outcome == "negative"
    # A trailing blank goes: two spans become one.
    assert [tuple(x) for x in found[1, 1].spans] == [(0, 3, "b")] and found[1, 0].crossing == found[1, 1].crossing == 1
    assert {k[0] for k in found} == {1, 2, 5}
    cut = chunking.sentence_examples(docs, spark.createDataFrame([(1, 1, 3, "a"), (1, 10, 19, "b"), (1, 14, 19, "c")], "doc_id long, s int, e int, lab string"))
    assert [r.outcome for r in sorted(cut.where("doc_id = 1").collect(), key=lambda r: r.sentence)][:2] == ["unaligned", "overlap"]
    row = chunking.example_counts(docs, spans).first()
    assert (row.sentences, row.blank, row.too_long, row.unaligned, row.example, row.negative, row.spans, row.crossing) == (len(found), 1, 1, 1, 2, 3, 2, 1)


def test_terms_in_the_texts_of_their_documents(spark):
    rows = spark.createDataFrame([(1, "AE", "SME1", "Pain"), (1, "AE", "LLM", "pain"), (2, "AE", "SME1", "PAIN"), (3, "AE", "SME1", "pain"), (1, "AE", "SME1", None)], "doc_id long, label string, note string, text string")
    pages = spark.createDataFrame([(1, "pain, Pain"), (2, "none"), (4, "pain")], "doc_id long, page string")
    got = {r.term: (r.human, r.ai, r.in_texts) for r in labels.inventory(rows, pages).collect()}
    assert got == {"pain": (3, 1, 2), None: (1, 0, 0)}


def test_functions_of_sql(spark):
    register(spark)
    register_tables(spark)
    one = lambda sql: [tuple(r) for r in spark.sql(sql).collect()]
    assert one("select clean_span('a  b c ', 1, 99).s, clean_span('a  b c ', 1, 99).e") == [(3, 6)] and one("select clean_span('   ', 0, 3).s = clean_span('   ', 0, 3).e") == [(True,)]
    assert one("select chunk, s, e from sliding_chunks('abc def ghi', 6, 2)")[0] == (0, 0, 6) and one("select * from sliding_chunks('', 6, 2)") == []
    assert one("select clean, s, e, lab, size(warnings) from parse_inline_tags('a <AE>b</AE> <AE>c', map('AE', 'X'))") == [("a b c", 2, 3, "X", 1)]
    assert one("select clean, s from parse_inline_tags(cast(null as string), map('AE', 'X'))") == [("", None)]
