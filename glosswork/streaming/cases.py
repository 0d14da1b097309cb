"""The annotations of cases as a stream of edits leaves them.

A post brings a case's whole set and takes the place of all that was there. Other
edits add, update, remove or dispute one annotation, and undo takes back an edit
that the case's history still has: what was added goes, what was removed comes
back, what was updated is as before. A post and a commit empty the history.

State is kept by case: the set and history up to a time, and the edits since, which
come in any order. At each batch the edits are put in order and replayed, so one that is late
by less than the watermark counts where it belongs, and one that comes again (the same time and
number) counts once. What is before a case's last post has no say in what follows, so it is dropped
from each Arrow batch before rows are shuffled, and from the state. When the watermark has passed, a timer folds edits into the set. A case is one key: its
edits are applied one after another, whatever the machines.

Defined results: null annotations count as none; an undo of an unknown edit, a removal
of what isn't there and an unknown action change nothing; rows of a null case,
time or number are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.keyed_table import KeyedTable, newest_of

ANNOTATION = "struct<label:string,s:int,e:int,text:string,note:string,disputed:boolean>"
FIELDS = ("label", "s", "e", "text", "note", "disputed")
Case = dict
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_case() -> Case:
    return {"annotations": [], "history": []}


def _same(a: dict, b: dict, *fields: str) -> bool:
    return all(a[f] == b[f] for f in fields)


def edited(case: Case, edit: dict) -> Case:
    """The case after an edit (event, action, annotations, undoes)."""
    annotations, history = case["annotations"], case["history"]
    given = [a for a in edit["annotations"] or [] if a]
    action, event = edit["action"], edit["event"]
    if action == "post":
        return {"annotations": given, "history": []}
    if action == "commit":
        return {"annotations": annotations, "history": []}
    if action == "undo":
        taken = next((h for h in history if h["event"] == edit["undoes"]), None)
        if taken is None:
            return case
        one, left = taken["annotation"], [h for h in history if h is not taken]
        if taken["action"] == "add":
            annotations = [a for a in annotations if not _same(a, one, "s", "e", "label", "note")]
        elif taken["action"] == "remove":
            annotations = [*annotations, one]
        elif taken["before"]:
            annotations = [taken["before"] if _same(a, one, "s", "e", "label", "note") else a for a in annotations]
        return {"annotations": annotations, "history": left}
    if not given:
        return case
    one, before = given[0], None
    if action == "add":
        annotations = [*annotations, one]
    elif action == "update":
        hit = [i for i, a in enumerate(annotations) if _same(a, one, "text", "s", "e", "label")]
        before = annotations[hit[-1]] if hit else None
        annotations = [a | {"note": one["note"]} if i in hit else a for i, a in enumerate(annotations)] if hit else [*annotations, one]
    elif action == "remove":
        at = next((i for i, a in enumerate(annotations) if _same(a, one, "text", "note", "s", "e") and (a["label"] or "").upper() == (one["label"] or "").upper()), None)
        if at is None:
            return case
        one, annotations = annotations[at], annotations[:at] + annotations[at + 1 :]
    elif action == "dispute":
        return {"annotations": [a | {"disputed": one["disputed"]} if _same(a, one, "s", "e", "text", "note") else a for a in annotations], "history": history}
    else:
        return case
    return {"annotations": annotations, "history": [*history, {"event": event, "action": action, "annotation": one, "before": before}]}


def replayed(case: Case, edits: Iterable[dict]) -> Case:
    """The case after edits, each number once, in order of time and number."""
    once = {(e["at"], e["event"]): e for e in edits}
    for key in sorted(once):
        case = edited(case, once[key])
    return case


def since_post(edits: list[dict]) -> list[dict]:
    """Of a case's edits, those from its last post on."""
    last = max(((e["at"], e["event"]) for e in edits if e["action"] == "post"), default=None)
    return edits if last is None else [e for e in edits if (e["at"], e["event"]) >= last]


def without_replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each batch without those that come before a post of their case."""
    for b in batches:
        case = pc.dictionary_encode(b.column("case")).indices.to_numpy()
        at, event = (b.column(x).to_numpy() for x in ("at", "event"))
        order = np.lexsort((event, at, case))
        case = case[order]
        posts = np.flatnonzero(pc.fill_null(pc.equal(b.column("action"), "post"), False).to_numpy(zero_copy_only=False)[order])
        last = np.full(case.max(initial=-1) + 1, -1)
        last[case[posts]] = posts  # ascending: a case's last one stays
        keep = np.zeros(len(case), bool)
        keep[order] = np.arange(len(case)) >= last[case]
        yield b.filter(pa.array(keep))


#: Edits of a case that are read before those that a post has replaced are dropped.
HELD = 10_000


class CaseProcessor(StatefulProcessor):
    """The set of each case after each batch that brought it edits."""

    def init(self, handle) -> None:
        self.handle = handle
        self.base, self.since = handle.getValueState("base", "upto long, body string"), handle.getValueState("since", "body string")

    def _held(self) -> tuple[int, Case, list[dict]]:
        base, since = self.base.get(), self.since.get()
        return (base[0], json.loads(base[1])) if base else (-(1 << 62), new_case()), json.loads(since[0]) if since else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (upto, case), since = self._held()
        known, full = {(e["at"], e["event"]) for e in since}, len(since) + HELD
        for r in rows:
            edit = {"at": r["at"], "event": r["event"], "action": r["action"], "undoes": r["undoes"], "annotations": [a and {f: a[f] for f in FIELDS} for a in r["annotations"] or []]}
            # What the timer has folded is over: a late edit would be out of turn.
            if r["at"] > upto and (edit["at"], edit["event"]) not in known:
                known.add((edit["at"], edit["event"]))
                since.append(edit)
                if len(since) >= full:
                    since = since_post(since)
                    known, full = {(e["at"], e["event"]) for e in since}, 2 * len(since) + HELD
        since = since_post(since)
        if since:
            self.since.update((json.dumps(since),))
            self.handle.registerTimer(max(e["at"] for e in since) // 1000 + 1)
        done = replayed(case, since)
        last = max((e["at"] for e in since), default=upto)
        yield Row(case=key[0], version=last, annotations=[Row(**{f: a[f] for f in FIELDS}) for a in done["annotations"]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (upto, case), since = self._held()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        folded = [e for e in since if e["at"] <= passed]
        if folded:
            self.base.update((max(upto, *(e["at"] for e in folded)), json.dumps(replayed(case, folded))))
            left = [e for e in since if e["at"] > passed]
            self.since.update((json.dumps(left),))
        return iter(())

    def close(self) -> None:
        pass


def edited_cases(edits: DataFrame, folder: str, *, late: str = "1 hour", trigger: Callable = lambda w: w.trigger(availableNow=True), buckets: int = 64) -> DataFrame:
    """case, version, annotations of each case after all edits (case, event, ts, action, annotations, undoes) that the stream has brought so far.

    Runs over what has come since the last run. Sets are merged into a table whose
    buckets are written anew only where a case of theirs was edited; version is the
    time of a case's last edit in microseconds.
    """
    spark = edits.sparkSession
    kind = edits.schema["case"].dataType.simpleString()
    rows = edits.where("`case` is not null and ts is not null and event is not null")
    rows = rows.select("case", "ts", F.unix_micros("ts").alias("at"), F.col("event").cast("long").alias("event"), "action", F.col("annotations").cast(f"array<{ANNOTATION}>").alias("annotations"), F.col("undoes").cast("long").alias("undoes"))
    rows = rows.mapInArrow(without_replaced, rows.schema).withWatermark("ts", late)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        sets = rows.groupBy("case").transformWithState(CaseProcessor(), f"`case` {kind}, version long, annotations array<{ANNOTATION}>", "Update", "EventTime")
        table = KeyedTable(spark, f"{folder}/table", sets.schema, ["case"], buckets=buckets)
        writer = sets.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress")
        trigger(writer.foreachBatch(lambda batch, number: table.merge(batch, number, newest_of(["case"], "version")) and None)).start().awaitTermination()
    finally:
        if held is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return table.read()
