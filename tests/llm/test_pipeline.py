import corpus_pipeline as cp
from glosswork.llm.common import checkpointed, read


def test_stages_keep_clean_documents_and_drop_the_rest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    quality = {r["doc_id"]: r["quality"] for r in read(spark, sf_dir, "labels").collect()}
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = checkpointed(stage(spark, before, sf_dir))
        assert after.columns == docs.columns, name
        had, has = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert set(has) <= set(had) and len(has) == after.count(), name
        if name == "quality classifier":
            good = [i for i in had if quality.get(i) == 1]
            assert sum(i in has for i in good) >= 0.9 * len(good)
        if name in ("line dedup", "benchmark decontamination"):
            assert set(has) == set(had) and all(r["n_chars"] == len(r["text"]) for r in has.values() if r["text"] is not None)
        before = after
    pieces = cp.packing(spark, before, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == set(has)
    used: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == used.get(p["sequence_id"], 0)
        used[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(used.values()) <= 2048


def test_near_duplicates_with_nulls_repeats_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, 1), (3, text + " more", 2), (3, text + " more", 2), (9, "another text of its own here", 3), (None, text, 4), (7, None, 5), (8, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid int")
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in cp.near_duplicates(spark, docs, "").collect())
    assert found == [(False, 3), (False, 7), (False, 8), (False, 9), (True, 0)]


def test_stages_read_the_written_results_of_the_ones_before(spark, sf_dir, monkeypatch):
    seen = []
    step = lambda spark, docs, sf_dir: seen.append(docs.inputFiles()) or docs.where("doc_id % 2 = 0")
    monkeypatch.setattr(cp, "STAGES", [("a", step), ("b", step), ("c", step)])
    kept = cp.run(spark, sf_dir).count()
    assert kept == read(spark, sf_dir, "documents").where("doc_id % 2 = 0").count()
    folder = "/" + spark.sparkContext.getCheckpointDir().rsplit("/", 1)[1] + "/"
    assert all(files and all(folder in f and f.endswith(".parquet") for f in files) for files in seen[1:]), seen


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, _drop string, _score double, n_lines int, n_dropped string, c0 int, own long, drop string, hash long, hit string, _row int, sid int"


def clashing_rows():
    long_text = " ".join(f"word{i} of prose" for i in range(60))
    line = "a line that is shared by many documents"
    texts = [long_text, long_text, None, "", " \n ", f"{line}\n{long_text} x", f"{line}\nmore of it here", f"{line}\nand again other words", "x" * 30_000, long_text]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    rows = [(i, t, "en", "s", -1, 10 + k, "t", "d", 0.5, -7, "n", k, 3, "e", 4, "h", 5, 6) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return [*rows, rows[0], rows[2], (2, "another text under a known id, of some words", "en", "s", -1, 99, "t", "d", 0.5, -7, "n", 99, 3, "e", 4, "h", 5, 6)]


def test_stages_keep_columns_of_any_name_nulls_and_repeated_rows(spark, sf_dir):
    docs = spark.createDataFrame(clashing_rows(), CLASHING)
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns and after.schema == docs.schema, name
        kept = after.collect()
        others = {tuple(v for c, v in r.asDict().items() if c not in ("text", "n_chars")) for r in docs.collect()}
        assert {tuple(v for c, v in r.asDict().items() if c not in ("text", "n_chars")) for r in kept} <= others, name
        if name in ("line dedup", "benchmark decontamination"):
            assert len(kept) == docs.count(), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    texts = {r["doc_id"]: r["text"] for r in cp.lines(spark, docs, sf_dir).collect() if r["doc_id"] in (6, 7, 8)}
    line = "a line that is shared by many documents\n"
    assert line not in texts[6] and line not in texts[7] and texts[8].startswith(line)
    found = cp.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None) for r in found).count((False, 1, False)) == 1
    assert not any(r["doc_id"] == 2 and r["text"].startswith("word0") for r in found)  # the copy goes, the other text of its id stays
    assert any(r["doc_id"] == 2 and r["text"].startswith("another") for r in found)
    assert cp.packing(spark, docs, sf_dir).columns[0] == "doc_id" and cp.packing(spark, docs.limit(0), sf_dir).count() == 0


def test_quality_judges_each_row_by_itself(spark, sf_dir):
    good = next(r["text"] for r in read(spark, sf_dir, "documents").collect() if r["text"] and r["text"].count(" ") > 100)
    junk = "### $$$ *** %%% " * 20
    docs = read(spark, sf_dir, "documents").unionByName(spark.createDataFrame([(None, good, None, None, 1), (None, junk, None, None, 1), (10**7, good, None, None, 1), (10**7, junk, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = [(r["doc_id"], r["text"]) for r in cp.quality(spark, docs, sf_dir).collect() if r["doc_id"] in (None, 10**7)]
    assert sorted(kept, key=str) == sorted([(None, good), (10**7, good)], key=str)
