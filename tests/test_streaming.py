"""Streams of edits in several batches, and tables of which a batch rewrites some buckets."""

import datetime
import itertools
import json
import random
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from glosswork.sources.keyed_table import KeyedTable, newest_of
from glosswork.streaming import cases, jobs

EDIT = f"`case` string, event long, ts timestamp, action string, annotations array<{cases.ANNOTATION}>, undoes long"
NOON = datetime.datetime(2024, 5, 1, 12)


def one(label, s=0, note="SME1", disputed=False):
    return (label, s, s + 4, "text", note, disputed)


def edit(case, event, minutes, action, *annotations, undoes=None):
    return (case, event, NOON + datetime.timedelta(minutes=minutes), action, list(annotations), undoes)


def run(spark, folder, *batches):
    """The sets after each batch, a run of the stream for each."""
    out = []
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, EDIT).coalesce(1).write.json(f"{folder}/in/{number}")
        stream = spark.readStream.schema(EDIT).json(f"{folder}/in/*")
        found = cases.edited_cases(stream, f"{folder}/out", buckets=4).collect()
        out.append({r["case"]: sorted((a.label, a.s, a.note, a.disputed) for a in r["annotations"]) for r in found})
    return out


def test_a_post_replaces_all_and_late_and_repeated_edits_count_where_they_belong(spark, tmp_path):
    a, b, c = one("A"), one("B", 10), one("C", 20)
    add = edit("k", 2, 10, "add", one("D", 30))
    first, second, third, fourth = run(
        spark, tmp_path,
        [edit("k", 1, 0, "post", one("Z")), add, edit("j", 9, 0, "add", a), edit(None, 1, 0, "add", a)],
        # A post of three, twenty minutes late: the addition after it stays. The addition comes again.
        [edit("k", 3, 5, "post", a, b, c), add, add, edit("k", 4, 11, "remove", one("b", 10))],
        # The next day folds what came before; the undo still finds the removal in the history.
        [edit("j", 10, 24 * 60, "add", b), edit("k", 5, 24 * 60, "undo", undoes=4)],
        # Beyond the watermark.
        [edit("k", 6, 12, "post"), edit("k", 7, 24 * 60 + 1, "undo", undoes=2), edit("j", 11, 24 * 60 + 1, "commit"), edit("j", 12, 24 * 60 + 2, "undo", undoes=10)],
    )
    assert first == {"k": [("D", 30, "SME1", False), ("Z", 0, "SME1", False)], "j": [("A", 0, "SME1", False)]}
    assert second["k"] == [("A", 0, "SME1", False), ("C", 20, "SME1", False), ("D", 30, "SME1", False)]
    assert third["k"] == sorted([*second["k"], ("B", 10, "SME1", False)]) and len(third["j"]) == 2
    assert fourth["k"] == [("A", 0, "SME1", False), ("B", 10, "SME1", False), ("C", 20, "SME1", False)]
    assert fourth["j"] == third["j"]  # a commit leaves nothing to undo


def test_edits_one_by_one():
    def after(*edits):
        rows = [{"at": i, "event": i, "action": e[0], "annotations": [dict(zip(cases.FIELDS, x, strict=True)) for x in e[1:] if isinstance(x, tuple)], "undoes": next((x for x in e[1:] if isinstance(x, int)), None)} for i, e in enumerate(edits)]
        return [(a["label"], a["note"], a["disputed"]) for a in cases.replayed(cases.new_case(), rows)["annotations"]]

    a = one("A")
    assert after(("add", a), ("add", a), ("remove", a)) == [("A", "SME1", False)]
    assert after(("add", a), ("add", a), ("undo", 1)) == []
    assert after(("post", a), ("update", one("A", note="N")), ("undo", 1)) == [("A", "SME1", False)]
    assert after(("update", a), ("undo", 0)) == [("A", "SME1", False)]  # nothing was there to restore
    assert after(("add", a), ("dispute", one("A", disputed=True)), ("undo", 1)) == [("A", "SME1", True)]
    assert after(("add", a), ("undo", 0), ("undo", 0), ("other", a), ("remove", a), ("undo", 9), ("add",)) == []


def test_a_batch_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path):
    r, folder = random.Random(3), str(tmp_path / "t")
    rows = {k: (k, f"v{k}", 0) for k in range(1000)}
    frame = lambda x: spark.createDataFrame(list(x), "k long, v string, n int")
    table = KeyedTable(spark, folder, frame([]).schema, ["k"], buckets=50)
    assert table.read().count() == 0 and len(table.merge(frame(rows.values()), 0, newest_of(["k"], "n"))) == 50
    files = lambda: {str(p) for p in Path(folder).rglob("*.parquet")}
    before = files()
    new = {k: (k, "new", 1) for k in r.sample(range(1000), 10)}
    touched = table.merge(frame(new.values()), 1, newest_of(["k"], "n"))
    assert len(touched) <= 10
    assert {int(x.split("bucket=")[1].split("/")[0]) for x in files() - before} == set(touched) and before <= files()
    assert sorted(map(tuple, table.read().collect())) == sorted((rows | new).values())
    # A batch that is done stays as it is; one that failed midway is run again.
    assert table.merge(frame([(1, "again", 9)]), 1, newest_of(["k"], "n")) == []
    (Path(folder) / "_done" / "1").unlink()
    assert sorted(map(tuple, table.read().collect())) == sorted(rows.values())
    table.merge(frame(new.values()), 1, newest_of(["k"], "n"))
    table.merge(frame([(7, "third", 2)]), 2, newest_of(["k"], "n"))
    table.merge(frame([(7, "fourth", 3)]), 3, newest_of(["k"], "n"))
    assert {r.k: r.v for r in table.read().collect()}[7] == "fourth" and table.done() == 3
    [own] = table.merge(frame([(7, "fifth", 4)]), 4, newest_of(["k"], "n"))
    versions = {x.split("version=")[1].split("/")[0] for x in files() if f"bucket={own}/" in x}
    assert versions == {"3", "4"}  # the last one before stays for readers that have begun


def test_the_newest_rows_of_several_batches(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(20), n, r.random() < 0.8) for n in range(200)]
    for number, part in enumerate(itertools.batched(rows, 50)):
        spark.createDataFrame(part, "k long, n long, good boolean").write.json(f"{tmp_path}/in/{number}")
        stream = spark.readStream.schema("k long, n long, good boolean").json(f"{tmp_path}/in/*")
        got = jobs.merge_latest(stream, ["k"], "n", f"{tmp_path}/out", good="good", buckets=5)
    assert sorted((x.k, x.n) for x in got.collect()) == sorted((k, max(n for j, n, g in rows if j == k and g)) for k in {j for j, _, g in rows if g})
    assert got.agg(F.count_distinct("k")).first()[0] == got.count()


class _State:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _State())

    def registerTimer(self, at):
        pass


def test_state_and_shuffle_hold_no_edits_before_a_post():
    rng, names = random.Random(4), ("post", "add", "update", "remove", "undo", "commit", "dispute", None)
    one = lambda: dict(zip(cases.FIELDS, (rng.choice("AB"), rng.randrange(3), 5, "t", "n", rng.random() < 0.5), strict=True))
    rows = [{"case": rng.choice("xyz"), "at": rng.randrange(900), "event": i, "action": rng.choices(names, (1, 4, 2, 2, 2, 1, 1, 1))[0], "annotations": [one()], "undoes": i - rng.randrange(4)} for i in range(3000)]
    kept = [r for b in cases.without_replaced(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=500))) for r in b.to_pylist()]
    assert len(kept) < 600
    for case in "xyz":
        own = [r for r in rows if r["case"] == case]
        expected = cases.replayed(cases.new_case(), own)["annotations"]
        assert cases.replayed(cases.new_case(), [r for r in kept if r["case"] == case])["annotations"] == expected
        processor, handle = cases.CaseProcessor(), _Handle()
        processor.init(handle)
        for k in range(0, len(own), 400):
            out = list(processor.handleInputRows((case,), iter(own[k : k + 400]), None))
        assert [a.asDict() for a in out[-1]["annotations"]] == expected and out[-1]["version"] == max(r["at"] for r in own)
        assert len(json.loads(handle.states["since"].value[0])) < 100
