"""Fill-in-the-middle: documents cut in three, the middle moved to the end behind markers.

Cuts fall between lines or between code points; texts are cut as UTF-8 bytes. A
text's index holds its multibyte characters alone: their positions and how many
bytes they have beyond one, summed up. A cut's code points are its bytes less the
excess of the characters before it, and the other way round, both by
``searchsorted``; where a text is ASCII the index is empty and the two are equal.

The forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>``
suffix ``<P>`` prefix ``<M>`` middle, ``plain`` the text as it is. Cuts, and which
form a document has, come from the sha256 of its id, so they are the same in any
task. No text with a marker inside is cut, so a form is undone without its cuts.

Defined results: null counts as empty; an empty text and one that holds a marker
are plain, without numbers of characters; a null id hashes as an empty string;
repeated rows give a row each; a text of any length is one row, cut whole; other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import encoded, record, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class MultibyteIndex:
    """The multibyte characters of a UTF-8 text: where they begin, and the bytes beyond one of those up to each."""

    def __init__(self, data: bytes):
        view = np.frombuffer(b"" if data.isascii() else data, np.uint8)
        self.at = np.flatnonzero(view >= 0xC0)
        lead = view[self.at]
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte positions that lie between characters."""
        return cuts - self.excess[np.searchsorted(self.at, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before positions in code points."""
        return cuts + self.excess[np.searchsorted(self.at - self.excess[:-1], cuts)]


def draws(seed: int, doc_id: str | None) -> list[int]:
    """The first four groups of eight digits of the id's sha256, as numbers."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def line_ends(data: bytes) -> np.ndarray:
    """Where each line ends, its line break included; the last needs none."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not data or data.endswith(b"\n") else np.append(ends, len(data))


def cut(data: bytes, doc_id: str | None, unit: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    index = MultibyteIndex(data)
    ends = line_ends(data) if unit == "line" else None
    n = len(ends) if unit == "line" else int(index.chars(np.array([len(data)]))[0])
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, data
    units = np.sort(np.array([h1 % (n + 1), h2 % (n + 1)], np.int64))
    if unit == "line":
        at = np.where(units > 0, ends[units - 1], 0)
        points = index.chars(at)
    else:
        points, at = units, index.bytes(units)
    first, second = at.tolist()
    before, middle, after = data[:first], data[first:second], data[second:]
    form, parts = ("spm", (SUFFIX, after, PREFIX, before, MIDDLE, middle)) if h4 % 100 < spm else ("psm", (PREFIX, before, SUFFIX, after, MIDDLE, middle))
    return n, form, int(points[0]), int(points[1] - points[0]), b"".join(parts)


def fill_in_middle(df: DataFrame, *, text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of df (doc_id, text).

    unit is line or char; of 100 documents about rate are cut, and of these about
    spm take the form spm.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit must be line or char")
    rows = df.select(F.col("doc_id").alias("doc_id"), F.col("doc_id").cast("string").alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            schema = pa.schema([b.schema.field(0), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
            found = [cut(data, key, unit, seed, rate, spm) for key, data in zip(b.column(1).to_pylist(), encoded(b, 2), strict=True)]
            n, form, before, middle, output = map(list, zip(*found, strict=True))
            yield record(schema, b.column(0), n, form, before, middle, pa.array(output, pa.binary()))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from a form and its output alone."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
