"""Defined results of the quality rules and the quality classifier."""

from glosswork.llm.quality import keep_quality, score_quality
from glosswork.llm.rules import apply_rules


def test_rules_on_nulls_ties_repeats_and_clashing_names(spark):
    prose = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, None, 1), (2, "", "a", 2), (3, " \n\t ", "a", 3), (4, prose, None, 4), (4, prose, None, 4), (None, prose, "a", 5), (5, "same words go on " * 40, "a", 6), (6, "x" * 40_000, "a", 7)]
    shared = [(100 + i, f"a line that stands everywhere on this host\n{' '.join(f'v{i}x{j}' for j in range(12 if i % 2 else 2))}", "h", 8) for i in range(40)]
    df = spark.createDataFrame(rows + shared, "doc_id long, text string, source string, n_words int")
    found = sorted((tuple(r) for r in apply_rules(df).select("doc_id", "n_words", "n_repeat_words", "base_failed", "n_left", "kept").collect()), key=str)
    assert len(found) == df.count()
    by = {r[0]: r[1:] for r in found}
    assert by[1] == by[2] == by[3] == (0, 0, True, 0, False)
    assert by[4] == by[None] == (30, 0, False, 30, True) and [r[0] for r in found].count(4) == 2
    assert by[5][2] and not by[5][4] and by[6][0] == 1
    # The line is in more than 20 of the host's documents: those with enough words of their own stay.
    assert all(by[100 + i] == ((20, 0, False, 12, True) if i % 2 else (10, 0, False, 2, False)) for i in range(40))
    assert apply_rules(df.limit(0)).count() == 0


def test_classifier_on_nulls_repeats_no_positives_and_empty_tables(spark):
    rows = [(i, "words of plain prose that go on for a while and end here" if i % 3 else "$$ ## %% ** $$", i) for i in range(60)] + [(None, None, 1), (70, "", 2), (70, "", 2), (71, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    found = score_quality(df, labels).collect()
    assert len(found) == df.count() and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["score"] for r in found}
    assert by[1] > by[3] and by[70] == by[71]
    assert {r["score"] for r in score_quality(df, labels.where("quality > 1")).collect()} == {0.5}
    assert score_quality(df.limit(0), labels).count() == 0 and score_quality(df, labels.limit(0)).count() == df.count()
    kept = keep_quality(df, labels, least=(by[1] + by[3]) / 2)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 4}
    assert 3 not in {r["doc_id"] for r in kept.collect()} and keep_quality(df.limit(0), labels).count() == 0
