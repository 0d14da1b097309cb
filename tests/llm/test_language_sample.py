from glosswork.llm.language import train


def test_a_rare_language_is_learned_beside_a_common_one(spark):
    rows = [(i, f"common words number {i % 50}", "en") for i in range(3000)] + [(3000 + i, "seltene Worte hier", "de") for i in range(2)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=30)
    assert sorted(model.langs) == ["de", "en"]


def test_viterbi_equals_the_best_of_all_paths():
    import itertools
    import random

    import numpy as np

    from glosswork.llm.language import viterbi

    r = random.Random(3)
    for _ in range(300):
        n, states, penalty = r.randint(1, 7), r.randint(1, 3), r.choice((0.5, 2.0, 5.0))
        scores = np.array([[-r.choice((0, 1, 2, 4, 9)) + r.random() / 100 for _ in range(states)] for _ in range(n)])
        scores -= scores.max(1, keepdims=True)
        value = lambda path, s=scores, p=penalty: sum(s[i, x] for i, x in enumerate(path)) - p * sum(a != b for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(states), repeat=n), key=value)
        found = viterbi(scores.astype(np.float64), scores.argmax(1), penalty)
        assert abs(value(found.tolist()) - value(best)) < 1e-9


def test_defined_results_of_language_identification(spark):
    from glosswork.llm.language import label_languages, train

    english, german = "the cat sat on the mat and looked at the moon " * 4, "der hund lief über die straße und suchte seinen ball " * 4
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", 1) for i in range(40)]
    docs = spark.createDataFrame([*rows, (90, None, "en", 2), (91, "", "de", 3), (92, "123 !?", None, 4), (None, english, None, 5), (93, german + english * 3, None, 6), (93, german + english * 3, None, 6)], "doc_id long, text string, lang string, spans int")
    model = train(docs)
    found = {r["doc_id"]: r for r in label_languages(docs, model).collect()}
    assert [found[i]["lang_pred"] for i in (90, 91, 92, None, 93, 3, 4)] == ["und", "und", "und", "en", "en", "en", "de"]
    assert [s["lang"] for s in found[93]["spans"]] == ["de", "en"] and 0.5 < found[93]["score"] < 1
    assert found[90]["score"] == 0 and label_languages(docs, model).count() == docs.count()
    assert train(docs.limit(0)) is None and label_languages(docs, None).where("lang_pred = 'und'").count() == docs.count()
    assert label_languages(docs.limit(0), model).count() == 0
    assert train(docs, sample_docs=1) is not None  # a sample is never empty
