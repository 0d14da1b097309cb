import hashlib
from collections import defaultdict

import pytest

from glosswork.llm.decontamination import NgramSet, find_contamination, remove_contamination, words
from glosswork.llm.line_dedup import drop_lines

LONG = "This line is found in many documents"


def test_lines_stay_in_the_largest_document(spark):
    rows = [
        (1, f"{LONG}\nonly here and nowhere else in it\n{LONG}", "a", 0), (2, f"  {LONG.upper()}\t\nshort", "a", 0), (3, f"{LONG} \n\n", "a", 0),
        (4, "short\nshort", "a", 0), (5, "short", "a", 0), (6, "short", None, 0), (7, None, "a", 0), (8, "", "a", 0), (None, LONG, "a", 0),
        (9, "in two documents alone, it stays", "a", 0), (10, "in two documents alone, it stays", "a", 0), (11, "ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ", "a", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, n_lines int")
    for batches in (1, 3, 12):
        out = {r.doc_id: r for r in drop_lines(df, batches=batches).collect()}
        assert len(out) == len(rows) and drop_lines(df).columns == ["doc_id", "text", "k1", "n_lines", "n_dropped"]
        assert out[1].text == "only here and nowhere else in it" and (out[1].n_lines, out[1].n_dropped) == (3, 2)
        assert out[2].text == "short" and out[3].text == f"{LONG} \n\n" and out[None].text == LONG
        assert out[4].text == "short\nshort" and out[7].text is None and out[7].n_lines == 1 and out[9].n_dropped == out[10].n_dropped == 0


def test_lines_against_brute_force(spark):
    from random import Random

    rng = Random(1)
    docs = [(i, "\n".join(rng.choice(["a" * 19, "B" * 20, " b" + "b" * 19, "é" * 19 + "x", "é" * 19, "", f"line number {rng.randint(0, 40):010d}"]) for _ in range(rng.randint(0, 9)))) for i in rng.sample(range(500), 90)]
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for doc_id, text in docs:
        for line in text.split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc_id)
    want = {d: "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 3 or d == max(held[key(x)])) for d, t in docs}
    out = drop_lines(spark.createDataFrame(docs, "doc_id long, text string"), batches=5, fanout=3).collect()
    assert {r.doc_id: r.text for r in out} == want


def test_lines_of_no_rows(spark):
    assert drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


ITEM = "one two three four five six seven eight nine ten eleven"


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, "Tiny item"), (3, None), (4, "..."), (10, ITEM + " twelve"), (None, "null id words here")], "item_id long, text string")


def test_contamination(spark, benchmark):
    rows = [(1, "x " + ITEM.upper().replace(" ", "; ") + "! y"), (2, "a TINY, item"), (3, "one two three"), (4, None), (5, ""), (6, "null id words here"), (6, "two three four five six seven eight nine ten eleven")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n_words int, items string")
    for max_words in (10**6, 5):
        got = sorted((r.doc_id, r.n_words, r.hit, r.items) for r in find_contamination(df, benchmark, max_words=max_words).collect())
        assert got == [(1, 13, list(range(1, 12)), ["1", "10"]), (2, 3, [1, 2], ["2"]), (3, 3, [], []), (4, 0, [], []), (5, 0, [], []), (6, 4, [], []), (6, 10, list(range(10)), ["1", "10"])]
    cleaned = sorted((r.doc_id, r.text or "", r.items) for r in remove_contamination(df, benchmark).collect())
    assert cleaned[0] == (1, "x ! y", "q") and cleaned[1] == (2, "a ", "q") and cleaned[-2][1] == ""


def test_rolling_hits_equal_plain_search():
    from random import Random

    rng = Random(4)
    pool = [b"a", b"b", b"c"]
    items = [(str(i), b" ".join(rng.choice(pool) for _ in range(rng.randint(1, 7)))) for i in range(6)]
    ngrams = NgramSet(items, 4)
    for _ in range(200):
        text = [rng.choice([*pool, b"z"]) for _ in range(rng.randint(0, 12))]
        hit, owners = set(), set()
        for name, item in items:
            w = words(item)
            size = min(4, len(w))
            for at in range(len(w) - size + 1):
                for p in range(len(text) - size + 1):
                    if text[p : p + size] == w[at : at + size]:
                        hit |= set(range(p, p + size))
                        owners.add(name)
        found, got = ngrams.find(text)
        assert set(found) == hit and got == owners


def test_no_benchmark_and_no_rows(spark, benchmark):
    empty = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert find_contamination(df, empty).first().hit == []
    assert find_contamination(df.limit(0), benchmark).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_runs_settle_keys_and_are_kept_between_calls(spark, tmp_path):
    from glosswork.llm.line_dedup import LineRuns

    batch = lambda rows: spark.createDataFrame(rows, "k1 long, k2 long, doc_id long")
    folder = str(tmp_path / "runs")
    LineRuns(spark, folder, fanout=3).add(batch([(1, 1, 90), (1, 1, 91), (1, 1, 92), (2, 2, 95)]))
    again = LineRuns(spark, folder, fanout=3)  # another call finds the first one's run
    again.add(batch([(1, 1, 50), (2, 2, 51), (3, 3, 52)]))
    assert [r[0] for r in again.runs()] == [0, 0]
    # What the runs settle adds nothing, what they know adds its count alone: this is the anti-join's work.
    second = sorted(tuple(r) for r in again.read(again.runs()[1]).collect())
    assert second == [(2, 2, 1, None), (3, 3, 1, 52)]
    again.add(batch([(2, 2, 10), (2, 2, 11), (1, 1, 12)]))
    assert [r[:3] for r in again.runs()] == [(1, 0, 2)]  # compacted
    assert sorted(tuple(r) for r in again.keys().collect()) == [(1, 1, 3, 92), (2, 2, 4, 95), (3, 3, 1, 52)]
    # A run that a lost compaction left behind is covered by the one that was made of it.
    spark.read.parquet(f"{folder}/run-1-0-2").write.parquet(f"{folder}/run-0-1-1")
    assert again.runs() == [(1, 0, 2)]


def test_contamination_in_parts_equals_that_in_one(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(14))) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"start {' '.join(f'w{k % 9}x{j}' for j in range(k % 16))} and end", k) for k in range(60)] + [(99, None, 1), (99, None, 1)], "doc_id long, text string, hit int")
    one, many = (sorted(map(tuple, find_contamination(docs, items, max_words=w).collect()), key=str) for w in (10**6, 20))
    assert one == many and any(r[2] for r in one)
    one, many = (sorted(map(tuple, remove_contamination(docs, items, max_words=w).collect()), key=str) for w in (10**6, 20))
    assert one == many
