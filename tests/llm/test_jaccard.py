import random
import time

from glosswork.llm.jaccard_join import link_documents


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, "ONE\ttwo"), (None, "one two"), (8, "x" * 50_000)]
    for base in range(6):
        words = [r.choice("abcdefghijklmnop") + str(r.randrange(40)) for _ in range(r.choice((12, 60, 150)))]
        for _ in range(12):  # a chain of near copies: each a change of the last
            if r.random() < 0.8:
                words = list(words)
                words[r.randrange(len(words))] = "w" + str(r.randrange(10**6))
            rows.append((r.randrange(10**6) + 10, " ".join(words)))
    r.shuffle(rows)
    return [*rows, rows[0], rows[-1]]


def test_links_equal_brute_force(spark):
    for seed, size, percent in ((1, 3, 90), (2, 5, 80), (3, 3, 60)):
        rows = corpus(seed)
        df = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, n string")
        found = link_documents(df, size=size, percent=percent, width=1 << 16).collect()
        assert sorted(map(tuple, found), key=str) == brute(rows, size, percent)


def test_empty_table(spark):
    assert link_documents(spark.createDataFrame([], "doc_id long, text string"), width=1 << 16).count() == 0


def test_links_do_not_hang_on_the_prefix_drop(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # With 16 counters each is raised often, so no shingle leaves a prefix; with 2^20 nearly all that are in one document do.
    found = [sorted(map(tuple, link_documents(df, size=3, percent=80, width=width).collect()), key=str) for width in (16, 1 << 20)]
    assert found[0] == found[1] == brute(rows, 3, 80)


def test_a_large_family_near_the_limit(spark):
    r = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(600):  # more than one block of classes that share most shingles and link only here and there
        words = list(base)
        for _ in range(r.randint(1, 3)):
            words[r.randrange(90)] = f"n{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    found = link_documents(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=90)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 3, 90)


def test_no_shuffle_outlives_its_job(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(key)
    link_documents(spark.createDataFrame(corpus(6), "doc_id long, text string"), size=3, percent=90, width=1 << 16)
    deadline = time.time() + 20
    while (left := shuffles() - before) and time.time() < deadline:  # files are removed in the background
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key) == setting
