import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm.fill_in_middle import MultibyteIndex, fill_in_middle, restored

ODD = ["a", "b ", "\n", "é", "漢", "😀", "\r\n", "<P", ">", "<", "S>", "\x00", " "]


def brute(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), out


def test_the_index_converts_both_ways():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 30)))
        index, data = MultibyteIndex(text.encode()), text.encode()
        chars = np.arange(len(text) + 1)
        places = np.array([len(text[:i].encode()) for i in chars])
        assert (index.bytes(chars) == places).all() and (index.chars(places) == chars).all()
        assert len(index.at) == sum(len(c.encode()) > 1 for c in text) and (not data.isascii() or not len(index.at))


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 100, 50), ("line", 40, 10)])
def test_outputs_against_brute_force(spark, unit, rate, spm):
    rng = random.Random(4)
    texts = [None, "", "\n", "\n\n", "one", "a <M> b\nc", "é\n漢😀\nx" * 50, "line é\n" * 200_000]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null\nid\n", "y"), (9, texts[9], "z"), (9, texts[9], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    out = fill_in_middle(df, unit=unit, rate=rate, spm=spm).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r) for r in out))) == sorted(repr((i, *brute(i, t, unit, rate, spm), t or "")) for i, t, _ in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_ids_of_text_and_no_rows(spark):
    out = fill_in_middle(spark.createDataFrame([("k1", "a\nb\n")], "doc_id string, text string")).collect()
    assert tuple(out[0]) == ("k1", *brute("k1", "a\nb\n"))
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), unit="word")
