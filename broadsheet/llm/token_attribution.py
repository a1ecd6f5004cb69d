"""Token counts by section: offset-mapped attribution.

A document is encoded once, whole, so its tokens are those that training will see; counting each section by itself would cut
words and merges at the borders.  The bytes of every token give its character span, and the spans are joined to the sections
they overlap: both are ordered inside a document, so the interval join is a search among the section starts, in the task that
encoded the text.  Nothing is shuffled.

A token that crosses a border is given away by one of these rules:

``first``  to the section of its first character (default);
``most``   to the section that holds most of its characters, the earlier one if equal;
``share``  in parts, to each section by its characters.

A token that is a part of one character has the span of that character.  The counts of a document's sections add up to its
tokens; what lies outside all sections is reported as section null.

Defined results: null and empty texts have no section and give one row with no tokens, so every document is seen; equal and
repeated rows are counted each for itself; empty sections have no tokens; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import tokens

RULES = ("first", "most", "share")
RESULT = "doc_id long, section int, start long, stop long, n_tokens double, n_crossing long, doc_tokens long"
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("n_tokens", pa.float64()),
    ("n_crossing", pa.int64()), ("doc_tokens", pa.int64()),
])


def spans(text: str, encoded, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of every token of the text."""
    ids = np.array(encoded(text), np.int64)
    if not len(ids):
        return ids, ids
    body = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((body & 0xC0) != 0x80) - 1  # of every byte
    stop = np.cumsum(sizes[ids])
    return character[stop - sizes[ids]], character[stop - 1] + 1


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text as sections; a line end belongs to its line."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    start = np.concatenate([[0], at])
    stop = np.append(at, len(text))
    full = stop > start
    return start[full], stop[full]


def attribute(first: np.ndarray, last: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and border-crossing tokens of each section (ascending, disjoint); one more cell holds what lies in none."""
    n = len(start)
    if not n:
        return np.array([float(len(first))]), np.array([0])
    a = np.searchsorted(start, first, side="right") - 1
    b = np.searchsorted(start, last - 1, side="right") - 1
    home = np.where((a >= 0) & (first < stop[a]), a, n)
    end = np.where((b >= 0) & (last - 1 < stop[b]), b, n)
    crossing = (a != b) | (home != end)
    counts = np.bincount(home[~crossing], minlength=n + 1).astype(float)
    crossed = np.zeros(n + 1, np.int64)
    for k in np.flatnonzero(crossing).tolist():
        f, e = int(first[k]), int(last[k])
        parts = [(int(j), min(e, int(stop[j])) - max(f, int(start[j]))) for j in range(max(0, int(a[k])), int(b[k]) + 1)]
        parts = [(j, c) for j, c in parts if c > 0]
        outside = (e - f) - sum(c for _, c in parts)
        if outside:
            parts.append((n, outside))
        for j, _ in parts:
            crossed[j] += 1
        if rule == "share":
            for j, c in parts:
                counts[j] += c / (e - f)
        else:
            best = home[k] if rule == "first" else max(parts, key=lambda p: p[1])[0]
            counts[best] += 1
    return counts, crossed


def count(documents: DataFrame, raw: bytes | None = None, rule: str = "first", sections: str | None = None) -> DataFrame:
    """Tokens per section.  ``sections`` names a column array<struct<start, stop>> of ascending disjoint character spans; without it the lines of the text are the sections."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    added = tokens.plain_added() if raw is None else ()
    raw = tokens.rank_file(tokens.PLAIN) if raw is None else raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = tokens.encode_all(raw, added)
        sizes = np.zeros(max([*tokens.ranks(raw).values(), *(i for _, i in added)]) + 1, np.int64)
        for b, i in [*tokens.ranks(raw).items(), *((t.encode(), i) for t, i in added)]:
            sizes[i] = len(b)
        for batch in batches:
            cells: list[list] = [[] for _ in _RESULT]
            given = batch.column(2) if sections else None
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                text = text.as_py() or ""
                if given is None:
                    start, stop = lines(text)
                else:
                    own = given[k].as_py() or []
                    start, stop = (np.array([s[x] for s in own if s], np.int64) for x in ("start", "stop"))
                first, last = spans(text, encoded, sizes)
                counts, crossed = attribute(first, last, start, stop, rule)
                n = len(start)
                outside = not n or counts[n] > 0
                m = n + outside
                for cell, values in zip(cells, (
                    [doc] * m, [*range(n), None][:m], [*start.tolist(), None][:m], [*stop.tolist(), None][:m],
                    counts[:m].tolist(), crossed[:m].tolist(), [len(first)] * m,
                )):
                    cell += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _RESULT.types)], schema=_RESULT)

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    if sections:
        columns.append(F.col(sections).cast("array<struct<start:bigint,stop:bigint>>"))
    return documents.select(*columns).mapInArrow(run, RESULT)


def digest(documents: DataFrame) -> DataFrame:
    """Tokens of every line of every document."""
    return count(documents)
